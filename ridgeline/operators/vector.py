"""Exact nearest vectors among live rows. The reference contract leaves the metric open; here it is a parameter.

One query is scored by built-in expressions, next to the scan; many queries by matrix products over Arrow
batches in double precision, where a pair costs a few nanoseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.vectors import METRICS, score

#: Query vectors per block: what a task gets at a time is at most this many vectors.
BLOCK = 1024


def _scores(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """(rows x queries); NaN where a cosine is undefined."""
    if metric == "l2":
        # Differences, not the expanded square: near-equal vectors keep their digits.
        return np.stack([np.sqrt(((rows - q) ** 2).sum(axis=1)) for q in queries], axis=1)
    product = rows @ queries.T
    if metric == "cosine":
        norms = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
        product = np.divide(product, norms, out=np.full_like(product, np.nan), where=norms > 0)
    return product


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, width))


def top_k(rows: DataFrame, query: list[float], k: int, metric: str = "cosine", key: str = "key", vec: str = "vec") -> DataFrame:
    """rows with score, the k nearest first; ties by key. Rows without a vector, or of another length, are skipped,
    and so are zero vectors with cosine."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k <= 0 or not query:
        return rows.withColumn("score", F.lit(0.0)).limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.where(F.size(vec) == len(query)).withColumn("score", score(F.col(vec), q, metric)).where("score IS NOT NULL AND NOT isnan(score)")
    return scored.orderBy(F.col("score") if metric == "l2" else F.col("score").desc(), key).limit(k)


def batch_top_k(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "key", vec: str = "vec", query_id: str = "query_id", query_vec: str = "query_vec", block: int = BLOCK) -> DataFrame:
    """(query_id, key, score, place): the k nearest rows of every query vector; rules as in top_k.

    The rows are read once. Queries are dealt into groups of about `block`, rows into as many shares as there are shuffle
    partitions; every share meets every group in a cell, and a task holds one group of queries while rows pass by. With
    one group, rows are not repeated and only the queries are. A task keeps k rows per query and batch; the final ranking sees only those.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark = rows.sparkSession
    base = rows.where(F.size(vec) > 0).select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("vec"))
    wanted = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("vec")).where("size(vec) > 0")
    kinds = base.schema["key"].dataType.simpleString(), wanted.schema["query_id"].dataType.simpleString()
    groups, shares = max(1, -(-wanted.count() // block)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = wanted.select(every(shares).alias("share"), F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("kind"), "query_id", F.lit(None).cast(kinds[0]).alias("key"), "vec")
    told = base.select(F.pmod(F.xxhash64("key"), F.lit(shares)).cast("int").alias("share"), every(groups).alias("group"), F.lit(1).alias("kind"), F.lit(None).cast(kinds[1]).alias("query_id"), "key", "vec")
    dealt = asked.unionByName(told).repartition("share", "group").sortWithinPartitions("share", "group", "kind", "key")
    found = dealt.mapInPandas(_nearest(k, metric), f"query_id {kinds[1]}, key {kinds[0]}, score double")
    nearest = F.col("score") if metric == "l2" else F.col("score").desc()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(nearest, "key"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _nearest(k: int, metric: str):
    """Over cells of queries (kind 0) and then rows (kind 1), sorted by key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held, sets = None, [], None
        for df in frames:
            mark = df["share"].to_numpy().astype(np.int64) * (1 << 32) + df["group"].to_numpy() * 2 + df["kind"].to_numpy()
            for part in np.split(np.arange(len(df)), np.flatnonzero(np.diff(mark)) + 1):
                rows = df.iloc[part]
                own = (rows["share"].iloc[0], rows["group"].iloc[0])
                if own != cell:
                    cell, held, sets = own, [], None
                if rows["kind"].iloc[0] == 0:
                    held.append(rows[["query_id", "vec"]])
                    continue
                if not held or k <= 0:
                    continue
                if sets is None:
                    queries = pd.concat(held)
                    widths = queries["vec"].map(len)
                    sets = {w: (queries["query_id"][widths == w].to_numpy(), _matrix(queries["vec"][widths == w], w)) for w in set(widths)}
                yield from _best(rows, sets, k, metric)

    return run


def _best(rows: pd.DataFrame, sets: dict, k: int, metric: str) -> Iterator[pd.DataFrame]:
    sizes = rows["vec"].map(len)
    for w, (ids, q) in sets.items():
        part = rows[sizes == w]  # sorted by key, so ties go to the smaller one
        if not len(part):
            continue
        s = _scores(_matrix(part["vec"], w), q, metric)
        cost = np.where(np.isnan(s), np.inf, s if metric == "l2" else -s)
        best = np.argsort(cost, axis=0, kind="stable")[:k]
        column = np.broadcast_to(np.arange(len(ids)), best.shape)
        legal = np.isfinite(cost[best, column])
        yield pd.DataFrame({"query_id": ids[column[legal]], "key": part["key"].to_numpy()[best[legal]], "score": s[best, column][legal]})
