import math
import random
import zlib

import numpy as np
import pytest

from ridgeline.llm import language_id as op

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "re"], "bb": ["sch", "ein", "ung", "pfe", "tz"], "cc": ["çao", "ñar", "ios", "que", "él"]}


def text(lang, n, rng):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return op.fit({k: [text(k, 60, rng) for _ in range(30)] for k in SYLLABLES})


def greedy(s, training):
    """Phrases of the greedy parse by plain substring search."""
    n, at = 0, 0
    while at < len(s):
        size = 0
        while at + size < len(s) and s[at : at + size + 1] in training:
            size += 1
        at += max(size, 1)
        n += 1
    return n


def test_automaton_knows_exactly_the_substrings():
    rng = np.random.default_rng(4)
    s = rng.integers(0, 3, 60).astype(np.uint8)
    step = op.suffix_automaton(s)
    base, owner, target = op.sparse([*step, {}], 5)
    known = {tuple(s[a:b]) for a in range(60) for b in range(a, 61)}
    todo, seen = [(0, ())], set()
    while todo:
        state, word = todo.pop()
        seen.add(word)
        for c in range(5):
            at = base[state] + c
            assert (owner[at] == state) == (c in step[state]) and (owner[at] != state or target[at] == step[state][c])
        todo += [(to, (*word, c)) for c, to in step[state].items() if len(word) < 60]
    assert seen == known
    assert not (owner == len(step)).any()


def test_phrases_match_brute_force():
    rng = random.Random(2)
    train = "".join(rng.choices("abc ", k=300))
    letters = op.alphabet([train])
    coded = op.symbols(train, letters)
    other = op.symbols("".join(rng.choices("cab ", k=200)), letters)
    model = op.Model.build({"x": coded, "y": other}, letters)
    for _ in range(20):
        s = op.symbols("".join(rng.choices("abcd ", k=rng.randrange(1, 200))), letters)
        if len(s):
            assert op.phrases([s], model)[0].tolist() == [greedy(bytes(s.astype(np.uint8)), bytes(x.astype(np.uint8))) for x in (coded, other)]
    parts = [op.symbols("abc " * 900, letters), np.zeros(0, np.int32), op.symbols("d", letters)]
    got = op.phrases(parts, model, stretch=1024)[:, 0]
    plain = [bytes(x.astype(np.uint8)) for x in (parts[0], coded)]
    assert got[1] == 0 and got[0] == sum(greedy(plain[0][k : k + 1024], plain[1]) for k in range(0, len(parts[0]), 1024))


SCRIPTS = {"latin": 0x61, "greek": 0x3B1, "cyrillic": 0x430, "arabic": 0x628, "devanagari": 0x915, "han": 0x4E00}


def test_a_hundred_languages_in_six_scripts():
    rng = random.Random(12)
    vocabularies = {}
    for k in range(100):
        name, start = list(SCRIPTS.items())[k % 6]
        letters = [chr(start + i) for i in range(400 if name == "han" else 20)]
        letters = [c for c in letters if c.isalpha() and c.lower() == c]
        weights = [rng.random() ** 3 for _ in letters]
        vocabularies[f"{name}{k}"] = ["".join(rng.choices(letters, weights, k=rng.randrange(1, 3) if name == "han" else rng.randrange(2, 8))) for _ in range(400)]
    say = lambda k, n: " ".join(rng.choices(vocabularies[k], [1 / (i + 1) for i in range(400)], k=n))
    model = op.fit({k: [say(k, 100) for _ in range(12)] for k in vocabularies}, op.Bounds(total=400_000))
    assert len(model.languages) == 100
    assert sum(getattr(model, x).nbytes for x in ("letters", "root", "nowhere", "base", "owner", "target")) < 100e6
    rows = [(k, say(k, rng.randrange(15, 80))) for k in vocabularies for _ in range(5)]
    names, _, novelty = op.predict([t for _, t in rows], model)
    assert sum(a == b for a, (b, _) in zip(names, rows)) >= 0.95 * len(rows)
    assert max(novelty) <= op.FOREIGN
    assert op.predict(["თბილისი საქართველოს დედაქალაქია"], model)[2][0] > op.FOREIGN  # a seventh script


def test_a_rare_language_is_not_at_a_disadvantage():
    rng = random.Random(5)
    model = op.fit({k: [text(k, 60, rng) for _ in range(n)] for k, n in (("aa", 80), ("bb", 80), ("cc", 2))})
    rows = [(k, text(k, 20, rng)) for k in SYLLABLES for _ in range(40)]
    assert sum(a == b for a, (b, _) in zip(op.predict([t for _, t in rows], model)[0], rows)) >= 0.98 * len(rows)


def test_held_out_accuracy(model):
    rng = random.Random(9)
    rows = [(k, text(k, rng.randrange(5, 200), rng)) for k in SYLLABLES for _ in range(60)]
    names, scores, novelty = op.predict([t for _, t in rows], model)
    assert sum(a == b for a, (b, _) in zip(names, rows)) >= 0.99 * len(rows)
    assert all(0 <= s <= 1 for s in scores) and all(0 < x <= op.FOREIGN for x in novelty)


def test_edges(model):
    names, scores, novelty = op.predict([None, "", "12 -- 34\n", "日本語", text("bb", 100_000, random.Random(3)), "KALO mitu Rekalo"], model)
    assert names[:3] == ["und"] * 3 and scores[:3] == [0.0] * 3
    assert names[3] in SYLLABLES and names[4:] == ["bb", "aa"]
    assert op.predict(["abc"], op.fit({})) == (["und"], [0.0], [1.0])
    one = op.fit({"only": ["some text here"]})
    assert op.predict(["words", None], one)[:2] == (["only", "und"], [1.0, 0.0])


def test_model_survives_packing(model):
    again = op.Model.unpack(model.pack())
    assert again.languages == model.languages and all((getattr(again, x) == getattr(model, x)).all() for x in ("letters", "root", "nowhere", "base", "owner", "target"))


def test_spark_trains_only_on_allowed_rows(spark):
    rng = random.Random(5)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    # Held-out rows carry a wrong language: nothing of it may be learned.
    rows = [(i, text(k, 40, rng), "wrong" if held(i) else k, "s") for i, k in enumerate(random.Random(6).choices(list(SYLLABLES), k=300))]
    rows += [(1000, None, "aa", None), (1001, "", None, None), (None, text("cc", 30, rng), None, None), (3, rows[3][1], rows[3][2], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'x' AS lang_pred", "1 AS score", "2 AS lang_guess")
    model = op.train(docs)
    assert set(model.languages) == set(SYLLABLES)
    found = op.identify(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "source", "lang_guess", "lang_pred", "score", "novelty"] and found.first()["lang_guess"] == 2
    out = found.select("doc_id", "lang_pred", "score", op.held_out().alias("held_out")).collect()
    assert len(out) == len(rows)
    truth = {i: k for i, (_, k) in enumerate(zip(range(300), random.Random(6).choices(list(SYLLABLES), k=300)))}
    assert all(r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"])) for r in out)
    got = {r["doc_id"]: r["lang_pred"] for r in out}
    assert got[1000] == got[1001] == "und" and got[None] == "cc"
    assert np.mean([got[i] == truth[i] for i in truth]) > 0.98


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert op.identify(docs, op.train(docs)).count() == 0


def test_score_grows_with_the_evidence(model):
    _, scores, _ = op.predict(["einung", text("bb", 50, random.Random(1))], model)
    assert 0 < scores[0] <= scores[1] <= 1 and not math.isnan(scores[0])


def test_foreign_texts_are_dropped(spark):
    rng = random.Random(7)
    rows = [(i, text(k, 30, rng), k, 1) for i, k in enumerate(list(SYLLABLES) * 20)]
    odd = [(900, "Ελληνικό κείμενο χωρίς ετικέτα", None, 2), (901, None, None, 2), (902, "12 34", None, 2), (903, text("bb", 3, rng), None, 2), (903, text("aa", 2, rng), None, 2)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score int")
    kept = op.drop_foreign(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [*range(60), 903, 903]
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) AS lang", "score")
    assert op.drop_foreign(unlabelled).count() == 63 and op.drop_foreign(docs.limit(0)).count() == 0
