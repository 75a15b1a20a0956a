"""Near-duplicate embeddings by random-hyperplane sign hashing.

Signs of random projections, in several tables, put vectors of a small angle into a common bucket with a
probability that is chosen. Buckets see identifiers and a 128-bit sketch of signs only; the vectors are fetched
for those that have a partner of about the right sketch, and these are compared exactly. A pair that meets in
several tables is counted only in the first, so links are counted without listing pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import attach, connected_components, durable, named, table

#: Signs in a sketch, two 64-bit words.
SKETCH = 128
#: Vectors that share a bucket by chance, about: comparing sketches costs less than moving more of them.
CHANCE = 128
#: Most rows of a list of split buckets that is broadcast (16 bytes each).
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Tables:
    """bits: signs per table. count: tables, enough to find a pair at the threshold with probability recall."""

    bits: int
    count: int
    seed: int = 20

    @staticmethod
    def sized(rows: int, threshold: float, recall: float = 0.9999) -> Tables:
        """For so many vectors of one label."""
        bits = min(31, max(6, math.ceil(math.log2(max(rows, 2) / CHANCE))))
        same = (1 - math.acos(threshold) / math.pi) ** bits
        return Tables(bits, math.ceil(math.log(1 - recall) / math.log(1 - same)))


@lru_cache(maxsize=8)
def _planes(width: int, tables: Tables) -> np.ndarray:
    return np.random.default_rng([tables.seed, width]).standard_normal((width, tables.bits * tables.count + SKETCH))


def _signs(vectors: np.ndarray, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """(rows x tables) bucket numbers and (rows x 2) sketches."""
    signs = vectors @ _planes(vectors.shape[1], tables) > 0
    in_tables = signs[:, : tables.bits * tables.count].reshape(len(vectors), tables.count, tables.bits)
    return (in_tables @ (1 << np.arange(tables.bits, dtype=np.int64))).astype(np.int32), np.packbits(signs[:, -SKETCH:], axis=1).view(np.int64)


def buckets(vectors: np.ndarray, tables: Tables) -> np.ndarray:
    return _signs(vectors, tables)[0]


def sketch_bound(threshold: float) -> int:
    """Differing signs of a sketch that a pair at the threshold exceeds with a probability below 1e-8."""
    p = math.acos(threshold) / math.pi
    return math.ceil(SKETCH * p + 6 * math.sqrt(SKETCH * p * (1 - p)))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which is exact, so that no square overflows or vanishes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def usable(vector: Column, label: Column) -> Column:
    """Whether a vector can be linked at all."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(label.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0.0), F.lit(False))


def _signed(frames: Iterator[pd.DataFrame], tables: Tables) -> Iterator[pd.DataFrame]:
    for df in frames:
        widths = df["vector"].map(len).to_numpy()
        for w in np.unique(widths):
            part = df[widths == w]
            codes, sketch = _signs(scaled(np.stack(part["vector"].to_numpy()).astype(np.float64)), tables)
            yield part.assign(codes=list(codes), sketch_a=sketch[:, 0], sketch_b=sketch[:, 1])


def _pairs_small(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j within each group."""
    index = np.repeat(starts, sizes)
    row = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    after = np.repeat(sizes, sizes) - row - 1
    left = np.repeat(index + row, after)
    right = np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after) + left + 1
    return left, right


def _groups(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return starts, np.diff(np.r_[starts, len(group)])


#: A place packs (table, own block, block one, block two); 17 bits for each of the last three.
_BLOCK = 1 << 17


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return place // _BLOCK**3, place // _BLOCK**2 % _BLOCK, place // _BLOCK % _BLOCK, place % _BLOCK


def _promising(df: pd.DataFrame, bound: int) -> pd.DataFrame:
    """Rows of whole groups that have a partner within `bound` signs of the sketch; of two blocks, in the other one."""
    starts, sizes = _groups(df["group"].to_numpy())
    sketch = np.ascontiguousarray(df[["sketch_a", "sketch_b"]].to_numpy()).view(np.uint64)
    _, own, one, two = _unpacked(df["place"].to_numpy())
    found = np.zeros(len(df), bool)
    small = sizes <= 24
    if small.any():
        left, right = _pairs_small(starts[small], sizes[small])
        for k in range(0, len(left), 500_000):
            a, b = left[k : k + 500_000], right[k : k + 500_000]
            near = (np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int32) <= bound) & ((one[a] == two[a]) | (own[a] != own[b]))
            found[a[near]] = True
            found[b[near]] = True
    for s, n in zip(starts[~small].tolist(), sizes[~small].tolist()):
        mine = sketch[s : s + n]
        for k in range(0, n, 256):  # a strip of the matrix at a time
            rows = slice(k, min(n, k + 256))
            near = np.bitwise_count(mine[rows, None, 0] ^ mine[None, :, 0]).astype(np.uint8) + np.bitwise_count(mine[rows, None, 1] ^ mine[None, :, 1]) <= bound
            near[np.arange(near.shape[0]), np.arange(rows.start, rows.stop)] = False
            if one[s] != two[s]:
                near &= own[s : s + n][rows, None] != own[s : s + n][None, :]
            found[s : s + n][rows] |= near.any(axis=1)
    return df.loc[found, ["group", "gid", "place"]]


class _Comparer:
    """Counts links and gathers connecting edges over whole groups."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def run(self, df: pd.DataFrame) -> pd.DataFrame:
        starts, sizes = _groups(df["group"].to_numpy())
        gid, copies = df["gid"].to_numpy(), df["copies"].to_numpy()
        at, own, one, two = _unpacked(df["place"].to_numpy())
        widths = df["vector"].map(len).to_numpy()
        v = np.zeros((len(df), int(widths.max())))
        for w in np.unique(widths):
            v[np.flatnonzero(widths == w)[:, None], np.arange(w)] = scaled(np.stack(df["vector"].to_numpy()[widths == w]).astype(np.float64))
        # Vectors of another length or label never link, should two buckets have one hash.
        kind = pd.factorize(pd.Series(list(zip(df["label"], widths))))[0]
        norm = np.sqrt(np.einsum("ij,ij->i", v, v))
        codes = np.stack(df["codes"].to_numpy())
        links, edges = np.zeros(len(df), np.int64), []

        def count(left, right):
            keep = (one[left] == two[left]) | (own[left] != own[right])  # two blocks: pairs across only
            left, right = left[keep], right[keep]
            for k in range(0, len(left), 100_000):
                a, b = left[k : k + 100_000], right[k : k + 100_000]
                earlier = np.arange(codes.shape[1])[None, :] < at[a][:, None]
                new = ~((codes[a] == codes[b]) & earlier).any(axis=1)
                np.add.at(links, a[new], copies[b[new]])
                np.add.at(links, b[new], copies[a[new]])

        small = sizes <= 24
        if small.any():
            left, right = _pairs_small(starts[small], sizes[small])
            for k in range(0, len(left), 100_000):
                a, b = left[k : k + 100_000], right[k : k + 100_000]
                cos = np.einsum("ij,ij->i", v[a], v[b]) / (norm[a] * norm[b])
                hit = (cos >= self.threshold) & (kind[a] == kind[b])
                a, b = a[hit], b[hit]
                count(a, b)
                edges.append(np.stack([gid[a], gid[b]]))
        for s, n in zip(starts[~small].tolist(), sizes[~small].tolist()):
            root = np.arange(n)
            for k in range(0, n, 256):  # a strip of the matrix at a time
                rows = slice(s + k, s + min(n, k + 256))
                cos = (v[rows] @ v[s : s + n].T) / (norm[rows][:, None] * norm[s : s + n][None, :])
                hit = (cos >= self.threshold) & (kind[rows][:, None] == kind[s : s + n][None, :])
                a, b = np.nonzero(hit)
                a += k
                up = a < b
                count(s + a[up], s + b[up])
                _unite(root, a[up], b[up])
            edges.append(np.stack([gid[s : s + n], gid[s + root]]))
        some = np.flatnonzero(links)
        e = np.concatenate([x for x in edges] or [np.zeros((2, 0), np.int64)], axis=1)
        e = np.unique(e[:, e[0] != e[1]], axis=1)
        return pd.DataFrame({"a": np.r_[gid[some], e[0]], "b": np.r_[gid[some], e[1]], "links": np.r_[links[some], np.zeros(e.shape[1], np.int64)]})


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the classes of a and b; root holds each row's smallest class member, fully resolved."""
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        todo = low != high
        if not todo.any():
            return
        a, b, low, high = a[todo], b[todo], low[todo], high[todo]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root[:] = root[root]


def _whole_groups(frames: Iterator[pd.DataFrame], work: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """work over whole groups of rows sorted by group; holds the open group and one batch."""
    held: list[pd.DataFrame] = []
    for df in frames:
        last = df["group"].iloc[-1]
        if df["group"].iloc[0] == last and (not held or held[-1]["group"].iloc[-1] == last):
            held.append(df)
            continue
        inner = df["group"].to_numpy() != last
        yield work(pd.concat([*held, df[inner]], ignore_index=True))
        held = [df[~inner]]
    if held:
        yield work(pd.concat(held, ignore_index=True))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, tables: Tables | None = None, crowd: int = 1000) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors link if their labels are equal and not null, their lengths are equal, and their cosine in double
    precision is at least the threshold. Null or zero vectors and those with null or non-finite components
    link with nothing. Equal vectors of a label are folded before hashing and count as links of each other;
    rows that repeat a vec_id are vectors of their own. A null vec_id is compared like any other row, but
    answers with the smallest vec_id of its component, or null. An empty table gives an empty result.

    Buckets with over `crowd` vectors are compared in pairs of blocks, so a task never holds more than two blocks.
    """
    key, body, kind = named([vec_id, vector, label])
    rows = vectors.select(key.cast("long").alias("vec_id"), F.transform(body, lambda x: x.cast("double")).alias("vector"), kind.cast("string").alias("label"))
    rows = durable(rows.select("vec_id", usable(F.col("vector"), F.col("label")).alias("ok"), F.struct("label", "vector").alias("spot")))
    folded = rows.where("ok").groupBy("spot").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # Numbered once, as the table is written; a number is the vector's own, whatever rows have it.
    folded = durable(folded.select(F.monotonically_increasing_id().alias("gid"), "spot", "spot.label", "spot.vector", "least", "copies"))
    most = folded.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    tables = tables or Tables.sized(most, threshold)

    schema = "gid long, label string, copies long, vector array<double>, codes array<int>, sketch_a long, sketch_b long"
    signed = durable(folded.select("gid", "label", "copies", "vector").mapInPandas(lambda frames: _signed(frames, tables), schema))
    seats = signed.select("gid", "sketch_a", "sketch_b", "label", F.size("vector").alias("width"), F.posexplode("codes").alias("at", "code"))
    seats = seats.select("gid", "sketch_a", "sketch_b", "at", F.xxhash64("label", "width", "at", "code").alias("bucket"))
    full = durable(seats.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("bucket", F.ceil(F.col("n") / crowd).cast("long").alias("parts")))
    split = full.count()
    if not split:
        placed = seats.select("*", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"), F.col("bucket").alias("group"))
    else:
        placed = seats.join(F.broadcast(full) if split <= BROADCAST_ROWS else full, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
        placed = placed.withColumn("block", F.pmod(F.xxhash64("gid"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        placed = placed.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
        placed = placed.withColumn("group", F.when(F.col("parts") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", "one", "two")))
    place = ((F.col("at").cast("long") * _BLOCK + F.col("block")) * _BLOCK + F.col("one")) * _BLOCK + F.col("two")
    dealt = placed.select("group", "gid", place.alias("place"), "sketch_a", "sketch_b").repartition("group").sortWithinPartitions("group")
    bound = sketch_bound(threshold)
    pairs = dealt.mapInPandas(lambda frames: _whole_groups(frames, lambda df: _promising(df, bound)), "group long, gid long, place long")
    carried = durable(pairs).join(signed.drop("sketch_a", "sketch_b"), "gid").repartition("group").sortWithinPartitions("group")
    found = durable(carried.mapInPandas(lambda frames: _whole_groups(frames, _Comparer(threshold).run), "a long, b long, links long"))

    links = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("links = 0").select("a", "b").distinct(), "a", "b")
    told = folded.select("gid", "spot", "least", "copies").join(links, folded.gid == links.a, "left").join(component, folded.gid == component.node, "left")
    told = durable(told.select("spot", "least", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "gid").alias("component")))
    least = durable(told.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    answers = durable(attach(told.drop("least"), least, "component", "members").select("spot", "copies", "n_links", "component_id"))
    linked = attach(rows.where("ok").select("vec_id", "spot"), answers, "spot", "copies").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id, vec_id AS reached FROM embeddings UNION SELECT r.vec_id, p.b FROM r JOIN p ON r.reached = p.a),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM p GROUP BY 1)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.vec_id
"""
