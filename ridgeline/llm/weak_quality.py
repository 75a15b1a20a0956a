"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain. Expectation-maximisation over the histogram of vote patterns
estimates how each labeller votes on good and on bad texts (Dawid and Skene, 1979), without any true label;
the posteriors then train a linear scorer on hashed words and word shapes, which scores every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import attach, durable, identity, named, table

GOOD, BAD, NONE = "+", "-", "0"


@dataclass(frozen=True)
class Settings:
    """rows: texts in the scorer's training sample, each of them whole. EM sees the votes of all texts."""

    rows: int = 3000
    bits: int = 12
    steps: int = 150
    penalty: float = 0.1
    doubt: int = 100  # a text of so many words counts half against the prior


# Labellers

_symbols = re.compile(r"[^\w\s]")
_digits = re.compile(r"\d")
_upper = np.fromiter(map(str.isupper, map(chr, range(0x110000))), bool, 0x110000)


def _capitals(text: str) -> int:
    return int(_upper[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].sum())


def _vote(value: float, good: tuple[float, float], bad: tuple[float, float]) -> str:
    """Good inside the first interval, bad outside of the second, else no vote."""
    if good[0] <= value <= good[1]:
        return GOOD
    return NONE if bad[0] <= value <= bad[1] else BAD


#: Name of each labeller, in the order of votes().
LABELLERS = ("length", "word_length", "symbols", "capitals", "digits", "variety", "top_word", "stutter", "repeated_lines", "sentence_ends")


def votes(text: str | None) -> str:
    """One character per labeller, by the same measures at every size.

    A text without words gets no vote but the first. With fewer than 40 words nobody votes on its length, variety or
    repetitions, nor bad on the length of its words; with fewer than 4 lines nobody votes on repeated lines, and a
    single line without an end is not bad.
    """
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return BAD + NONE * (len(LABELLERS) - 1)
    size = len(text)
    letters = sum(map(len, words))
    counts = Counter(words)
    lines = [x for x in (x.strip() for x in text.split("\n")) if x]
    few = n < 40
    return "".join((
        NONE if few else _vote(n, (80, 1e9), (0, 1e9)),
        _vote(letters / n, (4.2, 6.2), (3.4, 7.0) if not few else (0, 1e9)),
        _vote(len(_symbols.findall(text)) / size, (0.005, 0.045), (0.002, 0.075)),
        _vote(_capitals(text) / letters, (0.0, 0.06), (0.0, 0.2)),
        _vote(len(_digits.findall(text)) / size, (2.0, 2.0), (0.0, 0.15)),
        NONE if few else _vote(log(len(counts)) / log(n), (0.88, 1.0), (0.75, 1.0)),  # distinct words, as a power of all
        NONE if few else _vote(counts.most_common(1)[0][1] / n, (0.0, 0.1), (0.0, 0.2)),
        NONE if few else _vote(sum(map(str.__eq__, words, words[1:])) / n, (0.0, 0.03), (0.0, 0.08)),
        NONE if len(lines) < 4 else _vote(1 - len(set(lines)) / len(lines), (2.0, 2.0), (0.0, 0.3)),
        _vote(sum(x[-1] in ".!?:\"')»”…。！？" for x in lines) / len(lines), (0.9, 1.0), (0.6 if len(lines) > 1 else 0.0, 1.0)),
    ))


# Expectation-maximisation


def fit_labellers(patterns: dict[str, int], rounds: int = 200) -> tuple[float, np.ndarray]:
    """Prior of good and, per labeller, class (bad, good) and vote (-, 0, +), its probability.

    patterns: number of texts by vote string; at most 3 ** labellers entries whatever the corpus.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    v = np.array([["-0+".index(c) for c in k] for k in keys])
    onehot = np.eye(3)[v]
    sums = (v - 1).sum(axis=1)
    post = np.clip(0.5 + 0.45 * np.sign(sums) * np.minimum(1, np.abs(sums) / 2), 0.05, 0.95)
    prior, table_ = 0.5, np.full((v.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        w = np.stack([(1 - post) * n, post * n], axis=1)
        prior = float(np.clip(w[:, 1].sum() / n.sum(), 0.02, 0.98))
        table_ = np.einsum("pc,plv->lcv", w, onehot) + 1.0
        table_ /= table_.sum(axis=2, keepdims=True)
        new = posteriors(v, prior, table_)
        if np.abs(new - post).max() < 1e-7:
            break
        post = new
    return prior, table_


def posteriors(v: np.ndarray, prior: float, table_: np.ndarray) -> np.ndarray:
    logs = np.log(table_)[np.arange(v.shape[1])[None, :], :, v].sum(axis=1)
    odds = logs[:, 1] - logs[:, 0] + np.log(prior / (1 - prior))
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


# Hashed features

_MULTIPLIER, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_CLASS = np.zeros(256, np.uint8)
for _k in range(256):
    _c = chr(_k)
    _CLASS[_k] = ord("A") if "A" <= _c <= "Z" else ord("0") if _c.isascii() and _c.isdigit() else ord("a") if _k >= 128 or _c.isalpha() else _k
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _hashes(data: np.ndarray, word: np.ndarray, n: int, salt: int, bits: int) -> np.ndarray:
    """A bucket per word from the bytes of all words: a polynomial in the place within the word."""
    first = np.searchsorted(word, np.arange(n))
    place = np.arange(len(data)) - first[word]
    powers = np.cumprod(np.full(int(place.max()) + 1, _MULTIPLIER)) if len(data) else np.zeros(1, np.uint64)
    terms = (data.astype(np.uint64) + np.uint64(salt)) * powers[place]
    return ((np.add.reduceat(terms, first) * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words (ASCII lower case) and of their shapes (runs of letters or digits as one).

    A word that repeats the one before has shape 0.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    solid = (raw > 32) | ((raw < 9) | (raw > 13) & (raw < 32))
    starts = solid & ~np.r_[False, solid[:-1]]
    n = int(starts.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = (np.cumsum(starts) - 1)[solid]
    data = raw[solid]
    kind = _CLASS[data]
    new = np.r_[True, (kind[1:] != kind[:-1]) | (word[1:] != word[:-1])] | ~np.isin(kind, np.frombuffer(b"Aa0", np.uint8))
    words, shapes = _hashes(_LOWER[data], word, n, 1, bits), _hashes(kind[new], word[new], n, 977, bits)
    shapes[1:][words[1:] == words[:-1]] = 0
    return words, shapes


def stretches(text: str, size: int = 1_000_000) -> Iterator[str]:
    """The text in parts of about a million characters that end between words."""
    at = 0
    while at < len(text):
        to = at + size
        if to < len(text):
            gap = text.find(" ", to)
            to = gap if gap >= 0 else len(text)
        yield text[at:to]
        at = to


def profile(text: str, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of a whole text (words, then shapes), their shares of its words, and the number of words."""
    total, n = np.zeros(2 << bits, np.int64), 0
    for part in stretches(text):
        words, shapes = features(part, bits)
        total += np.bincount(np.r_[words, shapes + (1 << bits)], minlength=2 << bits)
        n += len(words)
    index = np.flatnonzero(total)
    return index, (total[index] / max(n, 1)).astype(np.float32), n


@dataclass
class Scorer:
    weights: np.ndarray  # of words, then of shapes
    center: float
    bias: float
    settings: Settings

    def score(self, text: str | None) -> float:
        """0 to 1; 0 for a text without words."""
        total, n = 0.0, 0
        for part in stretches(text or ""):
            words, shapes = features(part, self.settings.bits)
            total += float(self.weights[words].sum() + self.weights[shapes + (1 << self.settings.bits)].sum())
            n += len(words)
        if not n:
            return 0.0
        odds = self.bias + (total / n - self.center) * n / (n + self.settings.doubt)
        return 1 / (1 + float(np.exp(-np.clip(odds, -50, 50))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, int, float]], settings: Settings) -> Scorer:
    """Logistic regression on soft labels by accelerated gradient steps, over standardised features.

    rows: buckets, their shares of the text's words and shapes, its number of words, its target.
    """
    width = 2 << settings.bits
    x = np.zeros((len(rows), width), np.float32)
    y = np.array([r[3] for r in rows], np.float32)
    for k, (index, share, _, _) in enumerate(rows):
        x[k, index] = share
    if not len(rows):
        return Scorer(np.zeros(width), 0.0, 0.0, settings)
    mean, spread = x.mean(axis=0), np.sqrt(x.var(axis=0) + 1e-8)
    n = np.array([r[2] for r in rows], np.float32)
    x -= mean
    x *= (n / (n + settings.doubt))[:, None]
    x /= spread
    probe = np.ones(width, np.float32)
    for _ in range(8):
        probe = x.T @ (x @ (probe / np.linalg.norm(probe)))
    step = 1 / (0.25 * float(np.linalg.norm(probe)) / len(rows) + settings.penalty)
    w, last, bias = np.zeros(width, np.float32), np.zeros(width, np.float32), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for k in range(settings.steps):
        ahead = w + (k / (k + 3)) * (w - last)
        wrong = 1 / (1 + np.exp(-np.clip(x @ ahead + bias, -30, 30))) - y
        last, w = w, ahead - step * (x.T @ wrong / len(rows) + settings.penalty * ahead)
        bias -= float(wrong.mean())
    w = (w / spread).astype(np.float64)
    return Scorer(w, float(w @ mean), bias, settings)


# Spark


def label(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, identity, votes) of every row."""

    @F.pandas_udf("string")
    def cast(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([votes(t) for t in batch], dtype=object)

    key, body = named([doc_id, text])
    return docs.select(key.alias("doc_id"), identity(key, body).alias("identity"), cast(body.cast("string")).alias("votes"))


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, votes, posterior, score, kept (score of 0.5 or more) for every row, row for row.

    posterior: of being good, from the votes alone. score: of the trained scorer over the whole text, 0 for a
    null text or one without words. Equal texts get equal answers, so repeated rows do and ties do not arise. Other
    columns of docs are not read, whatever their names. An empty table gives an empty result.

    Votes are taken once and meet the scores by the identity of the row.
    """
    seen = durable(label(docs, doc_id, text))
    patterns = {r["votes"]: r["n"] for r in seen.groupBy("votes").agg(F.count("*").alias("n")).toLocalIterator()}  # at most 3 ** len(LABELLERS)
    if not patterns:
        return seen.select("doc_id", "votes", F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    prior, table_ = fit_labellers(patterns)
    keys = sorted(patterns)
    post = dict(zip(keys, posteriors(np.array([["-0+".index(c) for c in k] for k in keys]), prior, table_).tolist()))
    scorer = fit_scorer(_sample(docs, doc_id, text, post, sum(patterns.values()), settings), settings)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([scorer.score(t) for t in batch], dtype="float64")

    key, body = named([doc_id, text])
    scores = durable(docs.select(key.alias("doc_id"), identity(key, body).alias("identity"), scored(body.cast("string")).alias("score")))
    told = durable(seen.groupBy("identity").agg(F.first("votes").alias("votes"), F.count("*").alias("rows")))
    table_of = docs.sparkSession.createDataFrame(sorted(post.items()), "votes string, posterior double")
    out = attach(scores, told, "identity", "rows").join(F.broadcast(table_of), "votes")  # one row per pattern
    return out.select("doc_id", "votes", "posterior", "score", (F.col("score") >= 0.5).alias("kept"))


def _sample(docs: DataFrame, doc_id: str, text: str, post: dict[str, float], total: int, settings: Settings) -> list:
    """(buckets, shares, words, posterior) of about settings.rows rows, chosen by a hash of doc_id and text."""
    share = min(1.0, settings.rows / total)
    key, body = named([doc_id, text])
    place = F.pmod(F.xxhash64(F.lit(5), key, body), F.lit(1_000_000_000))
    rows = docs.where(place < int(np.ceil(1_000_000_000 * share))).select(body.cast("string").alias("text"), F.xxhash64(F.lit(6), key, body).alias("h"))

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for t, h in zip(df["text"], df["h"]):
                index, share, n = profile(t or "", settings.bits)
                if n:
                    out.append((h, index.astype(np.int32), share, n, votes(t)))
            yield pd.DataFrame(out, columns=["h", "index", "share", "n", "votes"])

    reduced = rows.mapInPandas(reduce, "h long, index array<int>, share array<float>, n int, votes string")
    got = reduced.orderBy("h", "n", "votes").limit(settings.rows).toLocalIterator()
    return [(np.array(r["index"]), np.array(r["share"], np.float32), r["n"], post.get(r["votes"], 0.5)) for r in got]


def query(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
