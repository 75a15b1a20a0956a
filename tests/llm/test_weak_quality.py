import random

import numpy as np
from pyspark.sql import functions as F

from ridgeline.llm import weak_quality as op

WORDS = "the quick brown fox jumps over lazy dogs while seven wizards quietly brew strong coffee near silver rivers today".split()


def good(rng):
    return "\n".join(" ".join(rng.choices(WORDS, k=rng.randrange(8, 16))).capitalize() + "." for _ in range(12))


def bad(rng):
    return rng.choice([lambda: "BUY NOW!!! " * 40, lambda: " ".join(w + rng.choice(["***", "$$$", "###"]) for w in rng.choices(WORDS, k=100)), lambda: " ".join([rng.choice(WORDS)] * 120), lambda: " | ".join(rng.choices(WORDS, k=100))])()


def auc(scores, truth):
    order = np.argsort(np.argsort(scores)) + 1.0
    t = np.array(truth, bool)
    return (order[t].sum() - t.sum() * (t.sum() + 1) / 2) / (t.sum() * (~t).sum())


def test_em_recovers_the_labellers():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.7
    accuracy, cover = [0.95, 0.85, 0.75, 0.65], [0.9, 0.7, 0.8, 0.5]
    patterns: dict[str, int] = {}
    for y in truth:
        p = "".join("0" if rng.random() > c else "+-"[int(y != (rng.random() < a))] if y else "-+"[int(rng.random() > a)] for a, c in zip(accuracy, cover))
        patterns[p] = patterns.get(p, 0) + 1
    prior, table = op.fit_labellers(patterns)
    assert abs(prior - 0.7) < 0.05
    for k, a in enumerate(accuracy):
        assert abs(table[k, 1, 2] / (table[k, 1, 2] + table[k, 1, 0]) - a) < 0.06


def test_classifier_separates_without_labels(spark):
    rng = random.Random(2)
    rows = [(i, good(rng) if i % 4 else bad(rng)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"votes": F.lit(1), "score": F.lit("x")})
    out = {r["doc_id"]: r for r in op.classify(docs).collect()}
    truth = [i % 4 > 0 for i in range(600)]
    assert auc([out[i]["score"] for i in range(600)], truth) > 0.97
    assert auc([out[i]["posterior"] for i in range(600)], truth) > 0.97
    assert all(out[i]["kept"] for i in range(600) if truth[i])
    again = {r["doc_id"]: r["score"] for r in op.classify(docs.repartition(5)).collect()}
    assert all(abs(again[i] - out[i]["score"]) < 1e-6 for i in range(600))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "word " * 400_000), (5, "é"), (None, "one two."), (5, "é"), (6, "\x00 ퟿")]
    out = op.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in out)
    assert all(r["score"] == 0 and not r["kept"] for r in out if r["doc_id"] in (1, 2, 3))
    assert op.classify(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_features_do_not_depend_on_the_place():
    a, s = op.features("Alpha beta  alpha ALPHA, x9\tbeta beta", 12)
    assert a[0] == a[2] == a[3] - 0 or a[3] != a[2]
    assert len(a) == len(s) == 7 and a[1] == a[5] and s[6] == 0 and s[1] == s[2]
    assert [len(x) for x in op.features("", 12)] == [0, 0]


def test_votes():
    rng = random.Random(1)
    assert op.votes(None) == op.votes("") == "-" + "0" * 9
    assert op.votes(good(rng)).count("-") <= 1 and op.votes("BUY NOW!!! " * 40).count("-") >= 3


def test_one_measure_at_every_size():
    """A text and its repetition get the same vote on capitals, in every script."""
    at = op.LABELLERS.index("capitals")
    for t, vote in (
        ("Сегодня утром мы долго гуляли по тихому берегу реки и разговаривали о книгах и о погоде.\n", "+"),
        ("Dziś rano długo spacerowaliśmy nad brzegiem cichej rzeki, rozmawiając o książkach, źródłach i żonach.\n", "+"),
        ("Σήμερα το πρωί περπατήσαμε πολλή ώρα δίπλα στο ποτάμι.\n", "+"), ("今天早上我们在河边散步很久，谈论书籍和天气。\n", "+"), ("СЕГОДНЯ УТРОМ МЫ ДОЛГО ГУЛЯЛИ\n", "-"), ("ŻÓŁĆ ŹRÓDŁO ŚWIT\n", "-"),
    ):
        assert {op.votes(t * k)[at] for k in (1, 2, 4, 40)} == {vote}, t
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(30_000)]
    weights = [1 / (k + 3) for k in range(30_000)]
    at = op.LABELLERS.index("variety")
    assert "-" not in {op.votes(" ".join(rng.choices(vocabulary, weights, k=n)))[at] for n in (50, 500, 1999, 2001, 20_000)}


def slow_em(rows, rounds):
    """Dawid and Skene over single texts, in plain loops."""
    post = []
    for r in rows:
        s = sum({"-": -1, "0": 0, "+": 1}[c] for c in r)
        post.append(min(0.95, max(0.05, 0.5 + 0.45 * (s > 0) * min(1, abs(s) / 2) - 0.45 * (s < 0) * min(1, abs(s) / 2))))
    for _ in range(rounds):
        prior = min(0.98, max(0.02, sum(post) / len(post)))
        share = []
        for k in range(len(rows[0])):
            share.append([])
            for good in (0, 1):
                n = {c: 1.0 for c in "-0+"}
                for r, p in zip(rows, post):
                    n[r[k]] += p if good else 1 - p
                share[-1].append({c: n[c] / sum(n.values()) for c in n})
        new = []
        for r in rows:
            a, b = prior, 1 - prior
            for k, c in enumerate(r):
                a *= share[k][1][c]
                b *= share[k][0][c]
            new.append(a / (a + b))
        moved = max(abs(x - y) for x, y in zip(new, post))
        if moved < 1e-7:
            break
        post = new
    return prior, new


def test_em_against_plain_loops():
    rng = random.Random(4)
    rows = ["".join(rng.choices("-0+", [1, 2, 4] if i % 3 else [4, 2, 1], k=6)) for i in range(300)]
    prior, table = op.fit_labellers(dict(__import__("collections").Counter(rows)), rounds=40)
    want_prior, want = slow_em(rows, 40)
    got = op.posteriors(np.array([["-0+".index(c) for c in r] for r in rows]), prior, table)
    assert abs(prior - want_prior) < 1e-6 and np.abs(got - want).max() < 1e-4


def test_scorer_against_plain_gradient_descent():
    """The same penalised logistic loss, minimised slowly over few features."""
    rng = np.random.default_rng(5)
    settings = op.Settings(bits=3, steps=3000, penalty=0.1)
    rows = []
    for _ in range(80):
        share = rng.random(16)
        rows.append((np.arange(16), (share / share.sum()).astype(np.float32), int(rng.integers(20, 400)), float(share[2] > share[5])))
    scorer = op.fit_scorer(rows, settings)
    x = np.stack([r[1] for r in rows]).astype(float)
    mean, spread = x.mean(axis=0), np.sqrt(x.var(axis=0) + 1e-8)
    n = np.array([r[2] for r in rows], float)
    z, y = (x - mean) / spread * (n / (n + settings.doubt))[:, None], np.array([r[3] for r in rows])
    w, bias = np.zeros(16), 0.0
    for _ in range(40_000):
        wrong = 1 / (1 + np.exp(-(z @ w + bias))) - y
        w -= 0.05 * (z.T @ wrong / len(y) + settings.penalty * w)
        bias -= 0.05 * wrong.mean()
    assert np.abs(scorer.weights * spread - w).max() < 0.01 * np.abs(w).max() and abs(scorer.bias - bias) < 0.02
    assert abs(scorer.center - (w / spread) @ mean) < 0.05 * max(1, abs(scorer.center))


def test_whole_texts_are_profiled():
    text = "alpha beta " * 300_000
    index, share, n = op.profile(text, 6)
    assert n == 600_000 and abs(share.sum() - 2) < 1e-3
    assert [x.tolist() for x in op.profile("alpha beta " * 3, 6)[:1]] == [index.tolist()] and op.profile("", 6)[2] == 0


def test_repeated_rows_and_clashing_columns(spark):
    t = "A plain sentence that is long enough. " * 4
    docs = spark.createDataFrame([(1, t), (1, t), (1, "x"), (None, t), (None, t)], "doc_id long, text string").withColumns({"identity": F.lit(1), "votes": F.lit(2), "rows": F.lit(3), "posterior": F.lit(4)})
    out = op.classify(docs).collect()
    assert len(out) == 5 and len({(r["votes"], r["score"]) for r in out}) == 2
