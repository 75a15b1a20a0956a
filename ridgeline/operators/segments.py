"""Sorted segments: statistics, sparse index and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.plans.state import numbered
from ridgeline.schema import DELETE


def statistics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bounds and counts of a segment, or of each group in `by`: one pass over narrow columns."""
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"),
        F.count_if(F.col("op") == DELETE).alias("tombstones"),
    )


def candidates(stats: DataFrame, key) -> DataFrame:
    """Segments whose bounds admit a key. Only key bounds may prune: by any other column the newest version of a
    key could be lost and an older one show."""
    return stats.where((F.col("min_key") <= key) & (F.col("max_key") >= key))


def sparse_index(rows: DataFrame, every: int, key: str = "key", seq: str = "seq", shards: list[str] | None = None) -> DataFrame:
    """(block, first_key, last_key, rows) for blocks of `every` rows of the sorted run, per shard.

    Without shards the run is numbered as a whole, range by range.
    """
    shards = shards or []
    if shards:
        number = F.row_number().over(Window.partitionBy(*shards).orderBy(key, F.col(seq).desc())) - 1
        placed = rows.withColumn("block", F.floor(number / every))
    else:
        placed = numbered(rows, F.col(key), F.col(seq).desc(), name="block").withColumn("block", F.floor(F.col("block") / every))
    return placed.groupBy(*shards, "block").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("rows"))


def block_of(index: DataFrame, key) -> DataFrame:
    """The first block whose last key is not below key."""
    return index.where(F.col("last_key") >= key).orderBy("block").limit(1)
