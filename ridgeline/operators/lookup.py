"""Point, bulk, range and prefix lookups over a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.plans.state import live
from ridgeline.schema import DELETE, key_bytes

#: A key list of at most this many bytes is sent to every executor; a longer one is shuffled.
BROADCAST_BYTES = 64 << 20


def get(log: DataFrame, key) -> DataFrame:
    """(value) of one key: one row, or none if it is absent or deleted."""
    return live(log.where(F.col("key") == F.lit(key_bytes(key)))).select("value")


def query(log: DataFrame, key) -> DataFrame:
    """(value, vec) of one key."""
    return live(log.where(F.col("key") == F.lit(key_bytes(key)))).select("value", "vec")


def fits_broadcast(keys: DataFrame, key: str = "key") -> bool:
    """Whether a key list is small enough to be sent to every executor: measured, not estimated."""
    return (keys.agg(F.sum(F.octet_length(F.col(key).cast("binary")) + 16)).first()[0] or 0) <= BROADCAST_BYTES


def multi_get(log: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Live rows of the keys in keys[key]; absent and deleted keys give no row.

    The keys' size is measured before they are broadcast; beyond the limit both sides are shuffled by key, which
    the choice of the newest version needs anyway. Repeated and null keys are dropped.
    """
    wanted = keys.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    side = F.broadcast(wanted) if fits_broadcast(wanted, key) else wanted
    return live(log.join(side, key, "left_semi"))


def live_over_base(base: DataFrame, tail: DataFrame) -> DataFrame:
    """Live rows of a base with one version per key and a tail of later segments.

    While the tail's keys fit a broadcast, the base is only scanned: rows whose key is not in the tail are final,
    and no row of the others leaves its place but for the tail's keys. Else all is ranked by key.
    """
    keys = tail.select("key").distinct()
    if not fits_broadcast(keys):
        return live(base.unionByName(tail))
    side = F.broadcast(keys)
    final = base.join(side, "key", "left_anti").where(F.col("op") != DELETE)
    return final.unionByName(live(base.join(side, "key", "left_semi").unionByName(tail)))


def key_range(log: DataFrame, low=None, high=None) -> DataFrame:
    """Live rows with low <= key < high, in unsigned byte order; an extension."""
    out = log
    if low is not None:
        out = out.where(F.col("key") >= F.lit(key_bytes(low)))
    if high is not None:
        out = out.where(F.col("key") < F.lit(key_bytes(high)))
    return live(out)


def key_prefix(log: DataFrame, prefix) -> DataFrame:
    """Live rows whose key starts with prefix; an extension."""
    low = key_bytes(prefix)
    high = bytearray(low).rstrip(b"\xff")
    if high:
        high[-1] += 1
    return key_range(log, low, high or None)


def dereference(pointers: DataFrame, blobs: DataFrame) -> DataFrame:
    """pointers (key, seq, value) with vec from blobs (key, seq, vec); a dangling pointer gives a null vec and
    dangling = true, never an error."""
    side = blobs.select("key", "seq", "vec")
    return pointers.join(side, ["key", "seq"], "left").withColumn("dangling", F.col("vec").isNull())
