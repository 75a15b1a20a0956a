"""SimHash near-duplicates by anchor-point covering.

Fingerprints are cut into blocks; two that differ in few bits differ in at most `reach` bits of some block.
Within a block the words of a covering code are anchors. A fingerprint's home is its nearest anchor, and
it visits every anchor within covering radius plus reach of its block. If two fingerprints differ in at
most reach bits of a block, one visits the other's home, so comparing visitors with residents per anchor
finds every link.

The code of a block is a Hamming code on its low bits (radius 1, perfect) times all words on the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import attach, connected_components, durable, identity, keep_rows, named, table

BITS = 64
SEED = 42
SHINGLE = 4
DISTANCE = 4


# Fingerprints


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, repeats included; a shorter text is one shingle, an empty one none."""
    words = text.encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return np.zeros(0, "<u8")
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(b" ".join(words), SEED)], "<u8")
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], "<u8")


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Bit i is 1 if it is 1 in over half of the hashes; 0 for a text without words. Signed."""
    hashes = shingle_hashes(text or "", width)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounds the bit matrix of a very long text
        part = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, identity) with fp a signed long and the identity of the row."""

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, width) for t in batch], dtype="int64")

    key, body = named([doc_id, text])
    return docs.select(key.alias("doc_id"), fp(body.cast("string")).alias("fp"), identity(key, body).alias("identity"))


# Anchors


@dataclass(frozen=True)
class Code:
    """Blocks of a fingerprint and the covering code in each. order: the Hamming code has 2**order - 1 bits."""

    blocks: int
    order: int
    distance: int = DISTANCE

    def __post_init__(self) -> None:
        if not 2 <= self.blocks <= BITS or not (1 << self.order) - 1 <= BITS // self.blocks:
            raise ValueError("from 2 blocks on, and the Hamming code must fit into a block")

    @property
    def reach(self) -> int:
        return self.distance // self.blocks

    def bounds(self) -> list[tuple[int, int]]:
        edges = [BITS * k // self.blocks for k in range(self.blocks + 1)]
        return list(zip(edges, edges[1:]))


#: Few visits but wide homes, and many visits but narrow homes; both find every link.
SMALL, LARGE = Code(3, 4), Code(2, 5)
LARGE_FROM = 5_000_000
#: Most rows of a list of split anchors that is broadcast (16 bytes each).
BROADCAST_ROWS = 100_000


@lru_cache(maxsize=8)
def _moves(width: int, order: int, most: int) -> list[np.ndarray]:
    """By syndrome: what to xor to a word so as to reach each code word within distance most, nearest first."""
    out: list[list[int]] = [[] for _ in range(1 << order)]
    for weight in range(most + 1):
        for bits in combinations(range(width), weight):
            s = 0
            for b in bits:
                s ^= b + 1 if b < (1 << order) - 1 else 0  # position b has syndrome b + 1; bits beyond the code have none
            out[s].append(sum(1 << b for b in bits))
    return [np.array(x, np.int64) for x in out]


def _syndrome(words: np.ndarray, order: int) -> np.ndarray:
    s = np.zeros(len(words), np.int64)
    for b in range((1 << order) - 1):
        s ^= ((words >> b) & 1) * (b + 1)
    return s


def visits(fps: np.ndarray, code: Code) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block and syndrome: anchor numbers, fingerprints, and whether the anchor is the home."""
    unsigned = fps.view(np.uint64)
    for k, (low, high) in enumerate(code.bounds()):
        words = ((unsigned >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype(np.int64)
        moves = _moves(high - low, code.order, 1 + code.reach)
        syndromes = _syndrome(words, code.order)
        for s in np.unique(syndromes):
            mine = syndromes == s
            anchors = words[mine][:, None] ^ moves[s][None, :]
            home = np.zeros(anchors.shape, bool)
            home[:, 0] = True  # the first move has weight 0 or 1: the nearest code word
            yield (anchors + (k << 33)).ravel(), np.repeat(fps[mine], len(moves[s])), home.ravel()


# Comparison per anchor


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= distance


def _forest(fps: np.ndarray, home: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """(fingerprint, those first reached from it): links enough to connect all that are linked.

    A resident is compared with all that are not reached yet, a visitor with the residents among them.
    """
    left = np.ones(len(fps), bool)
    for start in np.flatnonzero(home):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            open_ = np.flatnonzero(left if home[at] else left & home)
            if not len(open_):
                continue
            found = open_[_near(fps[at], fps[open_], distance)]
            if len(found):
                left[found] = False
                queue.extend(found.tolist())
                yield int(fps[at]), fps[found]


def anchor_links(groups: np.ndarray, fps: np.ndarray, home: np.ndarray, distance: int, small: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole groups (sorted by group) of residents and visitors."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    residents = np.add.reduceat(home.astype(np.int64), starts)
    pairs = residents * sizes
    a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    few = (pairs <= small) & (residents > 0) & (sizes > 1)
    member = np.repeat(few, sizes)
    rows = np.flatnonzero(home & member)
    group_of = np.repeat(np.arange(len(starts)), sizes)
    for k in range(0, len(rows), 50_000):
        r = rows[k : k + 50_000]
        n = sizes[group_of[r]]
        left = np.repeat(r, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[group_of[r]], n)
        hit = _near(fps[left], fps[right], distance) & (fps[left] != fps[right])
        a_out.append(fps[left[hit]])
        b_out.append(fps[right[hit]])
    for g in np.flatnonzero((pairs > small) & (residents > 0)):
        part = slice(starts[g], starts[g] + sizes[g])
        for at, found in _forest(fps[part], home[part], distance):
            a_out.append(np.full(len(found), at))
            b_out.append(found)
    a, b = np.concatenate(a_out), np.concatenate(b_out)
    return np.minimum(a, b), np.maximum(a, b)


def _links(frames: Iterator[pd.DataFrame], distance: int, most: int = 100_000) -> Iterator[pd.DataFrame]:
    """Over rows sorted by group, residents first. Holds the open group and one batch.

    Of a group with over `most` rows only the residents are held on: every batch of its visitors meets them, so
    that memory does not grow with the visitors.
    """
    held: list[pd.DataFrame] = []

    def flush(df: pd.DataFrame) -> pd.DataFrame:
        a, b = anchor_links(df["group"].to_numpy(), df["fp"].to_numpy(), df["home"].to_numpy(), distance)
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    for df in frames:
        last = df["group"].iloc[-1]
        if df["group"].iloc[0] == last and (not held or held[-1]["group"].iloc[-1] == last):
            held.append(df)
            if sum(map(len, held)) > most:
                whole = pd.concat(held)
                if not whole["home"].iloc[-1]:  # all residents are here
                    yield flush(whole)
                    held = [whole[whole["home"]]]
            continue
        cut = int(np.searchsorted(df["group"].to_numpy(), last))
        yield flush(pd.concat([*held, df.iloc[:cut]]))
        held = [df.iloc[cut:]]
    if held:
        yield flush(pd.concat(held))


def links(distinct: DataFrame, code: Code | None = None, crowd: int = 4000) -> DataFrame:
    """(a, b): links between the fingerprints in column fp, enough to connect all that are linked.

    An anchor with over `crowd` residents is split: each part has about `crowd` of the residents, and the visitors
    pass by it. The list of such anchors is broadcast only while it is short; a longer one is joined by anchor.
    """
    total = distinct.count()
    code = code or (SMALL if total < LARGE_FROM else LARGE)

    def seated(homes_only: bool):
        def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in frames:
                fps = df["fp"].to_numpy()
                for k in range(0, len(fps), 2000):
                    for anchor, fp, home in visits(fps[k : k + 2000], code):
                        of = home if homes_only else slice(None)
                        yield pd.DataFrame({"anchor": anchor[of], "fp": fp[of], "home": home[of]})

        return distinct.select("fp").mapInPandas(explode, "anchor long, fp long, home boolean")

    seats = seated(False)
    full = durable(seated(True).groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("anchor", F.ceil(F.col("n") / crowd).cast("int").alias("parts")))
    split = full.count()
    if not split:
        parted = seats.withColumn("part", F.lit(0))
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        parted = seats.join(F.broadcast(full) if split <= BROADCAST_ROWS else full, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        parted = parted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("home", F.col("home") & (F.col("part") == own))
    # Anchors are below 2**35, so the part fits above them.
    keyed = parted.select((F.col("anchor") + F.shiftleft(F.col("part").cast("long"), 36)).alias("group"), "fp", "home")
    dealt = keyed.repartition("group").sortWithinPartitions("group", F.desc("home"))
    return dealt.mapInPandas(lambda frames: _links(frames, code.distance), "a long, b long").distinct()


# Near-duplicates


def _components(docs: DataFrame, doc_id: str, text: str, code: Code | None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and one row per fingerprint: fp, n (its rows), component_id, keep_identity.

    A document of a component is the first by (null doc_id last, doc_id, identity).
    """
    fps = durable(fingerprints(docs, doc_id, text))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "identity"))
    distinct = durable(fps.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")))
    component = connected_components(links(distinct, code), "a", "b")
    placed = distinct.join(component, distinct.fp == component.node, "left")
    placed = durable(placed.select("fp", "n", "first", F.coalesce("component", "fp").alias("component")))
    least = durable(placed.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("fps")))
    named_ = attach(placed.select("fp", "n", "component"), least, "component", "fps")
    return fps, durable(named_.select("fp", "n", F.col("least.id").alias("component_id"), F.col("least.identity").alias("keep_identity")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", code: Code | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Equal fingerprints
    are folded first, so a group of copies is one fingerprint to compare. Rows that repeat a doc_id stay;
    null doc_ids count as larger than all others. An empty table gives an empty result.
    """
    fps, answers = _components(docs, doc_id, text, code)
    out = attach(fps.select("doc_id", "fp"), answers.drop("keep_identity"), "fp", "n")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", code: Code | None = None) -> DataFrame:
    """Exactly one row of each group stays, that of its smallest doc_id, columns unchanged.

    Of rows with that doc_id and different texts in the group, one stays; of rows that repeat both, one as well.
    """
    _, answers = _components(docs, doc_id, text, code)
    return keep_rows(docs, answers.select(F.col("keep_identity").alias("identity")).distinct(), doc_id, text)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
