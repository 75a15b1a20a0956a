"""Record model: the change log's schema, op codes and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, PUT_VECTOR, DELETE = 0, 1, 2

CHANGELOG = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("op", T.ByteType(), False),
    T.StructField("key", T.BinaryType(), False),
    T.StructField("value", T.BinaryType(), False),
    T.StructField("vec", T.ArrayType(T.FloatType(), False), True),
])
COLUMNS = CHANGELOG.fieldNames()


def _required(name: str) -> F.Column:
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"{name} must not be null")).cast("binary"))


def puts(rows: DataFrame) -> DataFrame:
    """(seq, key, value[, vec]) as change-log rows. A null value is empty; a null or empty vec makes a plain put."""
    vec = F.col("vec").cast("array<float>") if "vec" in rows.columns else F.lit(None).cast("array<float>")
    vec = F.when(F.size(vec) > 0, vec)
    op = F.when(vec.isNull(), PUT).otherwise(PUT_VECTOR).cast("byte")
    return rows.select(F.col("seq").cast("long").alias("seq"), op.alias("op"), _required("key").cast("binary").alias("key"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"), vec.alias("vec"))


def deletes(rows: DataFrame) -> DataFrame:
    """(seq, key) as tombstones: typed, with an empty value, unlike a live empty value."""
    return rows.select(F.col("seq").cast("long").alias("seq"), F.lit(DELETE).cast("byte").alias("op"), _required("key").cast("binary").alias("key"), F.lit(b"").alias("value"), F.lit(None).cast("array<float>").alias("vec"))


def key_bytes(key: bytes | bytearray | str) -> bytearray:
    """A key as the engine orders it: unsigned bytes, a prefix first. None is rejected, empty is legal."""
    if key is None:
        raise ValueError("key must not be null")
    return bytearray(key.encode() if isinstance(key, str) else key)
