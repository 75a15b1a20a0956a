"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of its labelled text. A text is parsed greedily into the longest
phrases that occur there. A phrase is worth a pointer into the training text, so the cross entropy (Ziv and
Merhav, 1993) is phrases * log(training symbols) / symbols, and the language with the least wins. The automata
of all languages are one sparse table, and many stretches of text take each step together in all of them.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import fresh, named, table

UNDETERMINED = "und"
#: A text of which more than this share of symbols begins a phrase is in none of the known languages.
FOREIGN = 0.6


@dataclass(frozen=True)
class Bounds:
    """What is gathered for training: rows of one language, symbols of one automaton and of all together.

    Whole texts are taken until the symbols are reached; that is also where the last one ends. With more languages
    each gets fewer symbols, so that the model does not grow: about 40 bytes a symbol, 80 MB in all.
    """

    documents: int = 600
    symbols: int = 80_000
    total: int = 2_000_000

    def share(self, languages: int) -> int:
        return max(1, min(self.symbols, self.total // max(1, languages)))


# Symbols: 0 is all that is not a letter (runs count once), then every letter of the training text, the most
# frequent first, and last a symbol for letters that no training text has.


def alphabet(texts: list[str]) -> np.ndarray:
    """A table from code points to symbols."""
    letters = Counter(c for t in texts for c in t.lower() if c.isalpha())
    known = sorted(letters, key=lambda c: (-letters[c], c))
    out = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000).astype(np.int32) * (len(known) + 1)
    for k, c in enumerate(known):
        out[ord(c)] = 1 + k
    return out


def symbols(text: str, table_: np.ndarray) -> np.ndarray:
    """The text's symbols, lower case, with a single gap between words and at both ends; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    s = table_[points]
    if not s.any():
        return np.zeros(0, np.int32)
    s = np.r_[np.int32(0), s, np.int32(0)]
    keep = s != 0
    keep[0] = True
    keep[1:] |= s[:-1] != 0
    return s[keep]


# Automata


def suffix_automaton(s: np.ndarray) -> list[dict[int, int]]:
    """Transitions by state of the automaton that knows every substring of s."""
    step: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in s.tolist():
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
        last = new
    return step


def sparse(step: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, target): the transition of state q by symbol c is target[base[q] + c], if owner says q there.

    Rows of the table are shifted so that they fill each other's gaps: those of several transitions first, each to
    the first place that is free for all of them, then single ones into what is left.
    """
    several = [q for q, x in enumerate(step) if len(x) > 1]
    several.sort(key=lambda q: -len(step[q]))
    edges = sum(map(len, step))
    base = np.zeros(len(step), np.int64)
    window = 1024
    free_at = np.ones(edges + 8 * width + 4 * window, bool)
    places: list[int] = []
    owners: list[int] = []
    targets: list[int] = []
    low = width
    for q in several:
        mine = sorted(step[q])
        at = low
        while True:
            if at + window + width >= len(free_at):
                free_at = np.r_[free_at, np.ones(len(free_at), bool)]
            fits = free_at[at : at + window].copy()
            for c in mine[1:]:
                fits &= free_at[at + c - mine[0] : at + c - mine[0] + window]
            k = int(fits.argmax())
            if fits[k]:
                break
            at += window
        at += k
        if at - low > window // 2:  # a crowded stretch: what is left of it goes to single transitions
            low += window // 4
        base[q] = at - mine[0]
        for c in mine:
            free_at[at - mine[0] + c] = False
            places.append(at - mine[0] + c)
            owners.append(q)
            targets.append(step[q][c])
    single = [(q, c, t) for q, x in enumerate(step) if len(x) == 1 for c, t in x.items()]
    end = max(places, default=width) + 1
    free = np.flatnonzero(free_at[:end])
    free = free[free >= width]
    slots = np.r_[free, np.arange(end, end + max(0, len(single) - len(free)))][: len(single)]
    size = int(max(end, slots.max(initial=0) + 1)) + width
    owner, target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    owner[places], target[places] = owners, targets
    if single:
        q, c, t = np.array(single).T
        base[q] = slots - c
        owner[slots], target[slots] = q, t
    return base.astype(np.int32), owner, target


@dataclass
class Model:
    """languages, most frequent first; sizes: training symbols of each; root[k, c]: from the start of language k by c."""

    languages: list[str]
    sizes: list[int]
    letters: np.ndarray
    root: np.ndarray
    nowhere: np.ndarray  # per language, the state before the first symbol and after an unknown one
    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray

    @staticmethod
    def build(coded: dict[str, np.ndarray], letters: np.ndarray) -> Model:
        width = int(letters.max(initial=0)) + 1
        bases, owners, targets, roots, nowhere = [], [], [], [], []
        states, slots = 0, 0
        for s in coded.values():
            base, owner, target = sparse([*suffix_automaton(s), {}], width)
            root = np.full(width, states + len(base) - 1, np.int32)
            known = owner[base[0] : base[0] + width] == 0
            root[known] = target[base[0] : base[0] + width][known] + states
            roots.append(root)
            nowhere.append(states + len(base) - 1)
            bases.append(base + slots)
            owners.append(np.where(owner >= 0, owner + states, -1))
            targets.append(target + states)
            states, slots = states + len(base), slots + len(owner)
        join = lambda x: np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32)
        return Model(list(coded), [len(s) for s in coded.values()], letters, np.array(roots, np.int32).reshape(len(coded), width), np.array(nowhere, np.int32), join(bases), join(owners), join(targets))

    def pack(self) -> tuple:
        """What is broadcast: each table is compressed by itself, so that no second copy of all is held."""
        return (self.languages, self.sizes, *(zlib.compress(np.ascontiguousarray(x), 1) for x in (self.letters, self.root, self.nowhere, self.base, self.owner, self.target)))

    @staticmethod
    def unpack(data: tuple) -> Model:
        tables = [np.frombuffer(zlib.decompress(x), np.int32) for x in data[2:]]
        tables[1] = tables[1].reshape(len(data[0]), -1)
        return Model(data[0], data[1], *tables)


def fit(samples: dict[str, list[str]], bounds: Bounds = Bounds()) -> Model:
    """A model from texts by language, most frequent first. Every non-empty language is learned.

    Where some texts of a language are better explained by another, they are left out and the automata built
    anew, so that mislabelled or mixed training rows do no harm.
    """
    letters = alphabet([t for texts in samples.values() for t in texts])
    coded = {k: [x for t in texts if len(x := symbols(t, letters))] for k, texts in samples.items()}
    coded = {k: v for k, v in coded.items() if v}
    most = bounds.share(len(coded))

    def build(chosen: dict[str, list[np.ndarray]], size: int) -> Model:
        return Model.build({k: np.concatenate(v)[:size] for k, v in chosen.items()}, letters)

    if len(coded) > 1:
        first = build(coded, max(1, most // 4))
        for k, name in enumerate(first.languages):
            own = [x for x, best in zip(coded[name], costs(coded[name], first).argmin(axis=1)) if best == k]
            coded[name] = own or coded[name]
    return build(coded, most)


def phrases(texts: list[np.ndarray], model: Model, stretch: int = 1024) -> np.ndarray:
    """(texts x languages): the number of longest-match phrases, restarted every `stretch` symbols."""
    spans = [(k, at) for k, x in enumerate(texts) for at in range(0, len(x), stretch)]
    out = np.zeros((len(texts), len(model.languages)), np.int64)
    if not spans or not model.languages:
        return out
    owner = np.array([k for k, _ in spans])
    sizes = np.array([min(stretch, len(texts[k]) - at) for k, at in spans])
    order = np.argsort(-sizes, kind="stable")
    # Few columns at a time where there are many languages: the states are a table of both.
    most = max(64, 200_000 // len(model.languages))
    for part in range(0, len(order), most):
        mine = order[part : part + most]
        grid = np.zeros((int(sizes[mine[0]]), len(mine)), np.int32)
        for column, j in enumerate(mine.tolist()):
            k, at = spans[j]
            grid[: sizes[j], column] = texts[k][at : at + stretch]
        live = np.searchsorted(-sizes[mine], -np.arange(len(grid)), side="left")  # columns that have a symbol at each step
        state = np.repeat(model.nowhere[:, None], len(mine), axis=1)
        count = np.zeros(state.shape, np.int32)
        for row, n in zip(grid, live.tolist()):
            c = row[:n]
            now = state[:, :n]
            slot = model.base.take(now)
            slot += c
            known = model.owner.take(slot) == now
            to = model.target.take(slot)
            language, column = np.nonzero(~known)
            to[language, column] = model.root[language, c[column]]
            count[language, column] += 1
            state[:, :n] = to
        np.add.at(out, owner[mine], count.T)
    return out


def costs(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """(texts x languages): bits for the phrases of the whole text."""
    return phrases(texts, model) * np.log2(np.array(model.sizes, float) + 1)


def predict(texts: list[str | None], model: Model) -> tuple[list[str], list[float], list[float]]:
    """Language, score and novelty of each text.

    Score: the share of evidence for the winner, from the entropies' difference to the next language in bits a
    symbol; 0 for und, 1 if only one language is known. Novelty: phrases of the winner per symbol, 1 for und.
    """
    coded = [symbols(t, model.letters) if t else np.zeros(0, np.int32) for t in texts]
    if not model.languages:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts), [1.0] * len(texts)
    n = np.array([len(x) for x in coded])
    counts = phrases(coded, model)
    entropy = counts * (np.log2(np.array(model.sizes, float) + 1)[None, :] / np.maximum(n, 1)[:, None])
    best = entropy.argmin(axis=1)  # ties: the language with most training rows
    names, scores, novelty = [], [], []
    for k in range(len(texts)):
        if not n[k]:
            names.append(UNDETERMINED)
            scores.append(0.0)
            novelty.append(1.0)
            continue
        names.append(model.languages[best[k]])
        others = np.delete(entropy[k], best[k])
        lead = float((others - entropy[k, best[k]]).min()) if len(others) else math.inf
        scores.append(1.0 if lead == math.inf else 1 / (1 + math.exp(-4 * min(lead, 100.0))))
        novelty.append(float(counts[k, best[k]] / n[k]))
    return names, scores, novelty


# Spark


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(named([doc_id])[0].cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", bounds: Bounds = Bounds()) -> Model:
    """A model from a bounded, hash-ordered sample of labelled rows that are not held out, of every language.

    Rows without a doc_id may be used. Texts that would fill a twentieth of an automaton alone come last, so that
    it is made of many texts where there are many. The driver gets at most three times the symbols of the model and
    one text a language beyond; the last text of a language ends where its bound is reached.
    """
    key, body, label = named([doc_id, text, lang])
    rows = docs.where(label.isNotNull() & ~held_out(doc_id) & (F.length(body) > 0)).select(label.cast("string").alias("lang"), key.alias("doc_id"), body.alias("text"), F.pmod(F.xxhash64(F.lit(7), key), F.lit(1_000_000)).alias("spread"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # one row per language
    most = bounds.share(len(counts))
    spark = docs.sparkSession
    if not counts:
        return Model.build({}, alphabet([]))
    # Four times as many as wanted on average: what is ranked is a small part of the table.
    part = spark.createDataFrame([(r["lang"], math.ceil(1_000_000 * min(1.0, 4 * bounds.documents / r["count"]))) for r in counts], "lang string, below long")
    chosen = rows.join(F.broadcast(part), "lang").where("spread < below").withColumn("long", F.length("text") > max(200, most // 20))
    order = Window.partitionBy("lang").orderBy("long", "spread", "doc_id", "text")
    chosen = chosen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= bounds.documents)
    before = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("text")
    sample = chosen.withColumn("before", before).where(F.col("before") < 3 * most).select("lang", "place", F.substring("text", 1, 3 * most).alias("text"))
    found: dict[str, list[str]] = {r["lang"]: [] for r in counts}
    for r in sample.orderBy("lang", "place").toLocalIterator():
        found[r["lang"]].append(r["text"])
    return fit(found, bounds)


_models: dict[int, Model] = {}  # of this Python worker


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of docs, all columns, with lang_pred, score and novelty of its whole text.

    Null texts and texts without letters are `und` with score 0 and novelty 1. Equal texts get equal answers; a tie
    goes to the language with most training rows. Columns of docs with the added names are replaced.
    """
    data = model.pack()
    mark, shared = zlib.crc32(b"".join(data[2:])), docs.sparkSession.sparkContext.broadcast(data)  # bounded by Bounds

    @F.pandas_udf("lang_pred string, score double, novelty double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if mark not in _models:
            _models.clear()
            _models[mark] = Model.unpack(shared.value)
        known = _models[mark]
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            values, at = batch.tolist(), 0
            while at < len(values):  # about a million characters at a time
                size, to = 0, at
                while to < len(values) and (to == at or size < 1_000_000):
                    size += len(values[to] or "")
                    to += 1
                for column, found in zip(out, predict(values[at:to], known)):
                    column += found
                at = to
            yield pd.DataFrame(dict(zip(("lang_pred", "score", "novelty"), out)))

    added = ("lang_pred", "score", "novelty")
    kept = [c for c in docs.columns if c.lower() not in added]
    (both,) = fresh(docs, "lang_guess")
    return docs.withColumn(both, guess(named([text])[0].cast("string"))).select(*named(kept), *[f"{both}.{c}" for c in added])


def drop_foreign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", bounds: Bounds = Bounds()) -> DataFrame:
    """The rows of docs that are in one of the languages of its labelled rows, columns unchanged.

    Rejected are texts without letters (null ones too), and those of which the best language explains so little that
    over FOREIGN of their symbols begin a new phrase: other scripts, above all. Where no row is labelled, nothing is
    known of any language, and only texts without letters go.
    """
    model = train(docs, doc_id, text, lang, bounds)
    if not model.languages:
        return docs.where(named([text])[0].rlike(r"\p{L}"))
    plain, guessed = docs.columns, fresh(docs, "lang_text")[0]
    told = identify(docs.select(F.struct(*named(plain)).alias("row"), named([text])[0].alias(guessed)), model, text=guessed)
    kept = told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("novelty") <= FOREIGN))
    return kept.select(*[F.col("row")[c].alias(c) for c in plain])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "novelty")
