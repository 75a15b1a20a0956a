"""State of every key as a query over its change log.

The newest version of a key counts as a whole row: fields are never merged, and a tombstone hides all that is
older. Predicates on anything but the key therefore stand above the choice of the newest version; predicates
on the key are pushed below it, to the scan, by the optimizer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.durable import durable
from ridgeline.schema import DELETE


def latest(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Newest row of each key, tombstones included. (key, seq) must be unique.

    Spark limits ranks per group before the shuffle too, so a key written a billion times sends one row per task.
    """
    newest = Window.partitionBy(key).orderBy(F.col(seq).desc())
    return log.withColumn("__rank", F.row_number().over(newest)).where("__rank = 1").drop("__rank")


def latest_narrow(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The same by a partial maximum and a join: wide rows are not sorted, at the price of reading the log twice."""
    top = log.groupBy(key).agg(F.max(seq).alias(seq))
    return log.join(top, [key, seq], "left_semi")


def live(log: DataFrame, key: str = "key", seq: str = "seq", op: str = "op") -> DataFrame:
    """Rows of keys whose newest version is not a tombstone."""
    return latest(log, key, seq).where(F.col(op) != DELETE)


def as_of(log: DataFrame, until: int, key: str = "key", seq: str = "seq", op: str = "op") -> DataFrame:
    """The live rows as they were after change `until`."""
    return live(log.where(F.col(seq) <= until), key, seq, op)


def shadowed(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """(key, versions, dead) per key: dead counts what compaction would remove."""
    return log.groupBy(key).agg(F.count("*").alias("versions"), (F.count("*") - 1).alias("dead"))


def merge_runs(runs: list[DataFrame], key: str = "key", seq: str = "seq") -> DataFrame:
    """All versions of several runs, by column name; a repeated (key, seq) is one version, that of the first run.

    Ranks are limited before the shuffle, so runs that repeat each other send each version once per task.
    """
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r.withColumn("__run", F.lit(k)) for k, r in enumerate(runs)])
    first = Window.partitionBy(key, seq).orderBy("__run")
    return every.withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__rank", "__run")


def first_hit(tiers: list[DataFrame], key: str = "key") -> DataFrame:
    """From tiers, newest first, the row of the first tier that has the key; a tombstone is a hit.

    Within a tier keys are unique. The answer is the same as by seq if every tier is newer than the next.
    """
    ranked = reduce(lambda a, b: a.unionByName(b), [t.withColumn("tier", F.lit(k)) for k, t in enumerate(tiers)])
    return latest(ranked.withColumn("__order", -F.col("tier")), key, "__order").drop("__order")


def ordered_run(log: DataFrame, key: str = "key", seq: str = "seq", partitions: int | None = None) -> DataFrame:
    """All versions, keys ascending, newest first within a key: ranges of (key, seq), each sorted by itself, so that
    the versions of one very frequent key are shared out too."""
    order = (F.col(key), F.col(seq).desc())
    dealt = log.repartitionByRange(partitions, *order) if partitions else log.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order)


def numbered(rows: DataFrame, *order, name: str = "number") -> DataFrame:
    """rows with their place in the order, from 0: ranges of it are sorted by themselves and begin where those before
    them end. No task sees more than its range; the driver gets one count per range. The result is durable."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits of such an identifier are the partition, the lower 33 the place in it.
    placed = durable(sorted_rows.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    starts, at = [], 0
    for k in sorted(counts):
        starts.append((k, at))
        at += counts[k]
    start = rows.sparkSession.createDataFrame(starts, "__part long, __start long")
    out = placed.withColumn("__part", part).join(F.broadcast(start), "__part")
    return out.withColumn(name, F.col("__start") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__part", "__start")


def compacted(log: DataFrame, drop_tombstones: bool, low_water: int | None = None, key: str = "key", seq: str = "seq", op: str = "op") -> DataFrame:
    """Newest version per key. Tombstones may go only if the input covers all that is older, and, with
    low_water, only those that no late writer can still undercut."""
    newest = latest(log, key, seq)
    if not drop_tombstones:
        return newest
    settled = F.lit(True) if low_water is None else F.col(seq) <= low_water
    return newest.where((F.col(op) != DELETE) | ~settled)
