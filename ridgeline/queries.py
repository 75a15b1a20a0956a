"""Registry of the engine's queries over the driver's tables, and the SQL each must agree with.

The change log is derived from ``events``: key user:<user_id>, seq event_id, a tombstone for every 'error'.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.durable import durable, shared_dir
from ridgeline.functions.frames import decode, frame, frame_bytes
from ridgeline.operators import lookup
from ridgeline.operators.segments import block_of, candidates, sparse_index, statistics
from ridgeline.operators.vector import batch_top_k, top_k
from ridgeline.plans import state
from ridgeline.schema import CHANGELOG, PUT_VECTOR
from ridgeline.sources import logs
from ridgeline.sources.files import Folder
from ridgeline.sources.store import Store
from ridgeline.streaming.ingest import ingest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, op, key, value) derived from events; key as text."""
    e = _table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", 2).otherwise(0).cast("byte")
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), "value")


def _binary(log: DataFrame) -> DataFrame:
    return log.select("seq", "op", F.col("key").cast("binary").alias("key"), F.col("value").cast("string").cast("binary").alias("value"), F.lit(None).cast("array<float>").alias("vec"))


def _text(rows: DataFrame) -> DataFrame:
    return rows.select("seq", F.col("key").cast("string").alias("key"), F.col("value").cast("string").cast("double").alias("value"))


def _orders(spark, sf_dir) -> DataFrame:
    """Orders as a change log keyed by customer; every 10th order is a tombstone."""
    o = _table(spark, sf_dir, "orders")
    key = F.lpad(F.col("o_custkey").cast("string"), 8, "0")
    return o.select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 10 == 0, 2).otherwise(0).cast("byte").alias("op"), key.alias("key"), F.col("o_totalprice").alias("value"), (F.col("o_orderkey") % 3).cast("int").alias("run"))


def _vectors(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"), "label")


def _workspace(spark: SparkSession) -> str:
    """A new folder for a query's own files, in the session's shared folder."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def _money(column: str):
    """A double as text that every engine writes alike."""
    return F.col(column).cast("decimal(18,2)").cast("string")


# Queries


def lww_live(spark, d):
    return state.live(changes(spark, d)).select("key", "seq", "value")


def lww_live_narrow(spark, d):
    return state.latest_narrow(changes(spark, d)).where("op <> 2").select("key", "seq", "value")


def tombstoned_keys(spark, d):
    return state.latest(changes(spark, d)).where("op = 2").select("key", "seq")


def delete_then_revive(spark, d):
    """Puts whose key had just been deleted."""
    from pyspark.sql import Window

    before = F.lag("op").over(Window.partitionBy("key").orderBy("seq"))
    return changes(spark, d).withColumn("before", before).where("before = 2 AND op = 0").select("key", "seq", "value")


def point_get(spark, d):
    return lookup.get(changes(spark, d).withColumn("key", F.col("key").cast("binary")), "user:7")


def point_get_absent(spark, d):
    return lookup.get(changes(spark, d).withColumn("key", F.col("key").cast("binary")), "user:none")


def point_get_deleted(spark, d):
    log = changes(spark, d).withColumn("key", F.col("key").cast("binary"))
    end = log.agg((F.max("seq") + 1).alias("seq")).select("seq", F.lit(2).cast("byte").alias("op"), F.lit("user:7").cast("binary").alias("key"), F.lit(0.0).alias("value"))
    return lookup.get(log.unionByName(end), "user:7")


def multi_get(spark, d):
    keys = _table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"))
    return lookup.multi_get(changes(spark, d), keys).select("key", "seq", "value")


def range_scan(spark, d):
    log = changes(spark, d).withColumn("key", F.col("key").cast("binary"))
    return lookup.key_range(log, "user:1", "user:2").select(F.col("key").cast("string").alias("key"), "seq", "value")


def prefix_scan(spark, d):
    log = changes(spark, d).withColumn("key", F.col("key").cast("binary"))
    return lookup.key_prefix(log, "user:10").select(F.col("key").cast("string").alias("key"), "seq", "value")


def empty_value_vs_tombstone(spark, d):
    """Purchases write an empty value: still live, unlike a tombstone."""
    e = _table(spark, d, "events")
    op = F.when(F.col("event_type") == "error", 2).otherwise(0)
    value = F.when(F.col("event_type") == "purchase", "").otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
    log = e.select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("key"), value.alias("value"))
    return state.live(log).select("key", F.length("value").cast("long").alias("value_length"), (F.col("value") == "").alias("is_empty"))


def vector_overwritten_by_plain_put(spark, d):
    """A second, plain put for every third vector: the whole row is replaced, so the vector is gone."""
    first = _vectors(spark, d).select(F.col("key").alias("seq"), F.lit(PUT_VECTOR).cast("byte").alias("op"), "key", F.col("label").cast("string").alias("value"), "vec")
    again = first.where("key % 3 = 0").select((F.col("seq") + 1_000_000_000).alias("seq"), F.lit(0).cast("byte").alias("op"), "key", F.lit("plain").alias("value"), F.lit(None).cast("array<float>").alias("vec"))
    return state.live(first.unionByName(again)).select("key", "value", F.col("vec").isNotNull().alias("has_vector"))


def tier_precedence(spark, d):
    """Three tiers, newest first, each with one version per key: the first hit wins, a tombstone too."""
    o = _orders(spark, d)
    tiers = [state.latest(o.where(F.col("run") == k)).select("key", "seq", "op", "value") for k in (2, 1, 0)]
    return state.first_hit(tiers).where("op <> 2").select("key", "seq", "value", "tier")


def ordered_run(spark, d):
    """Each version's place within its key in the sorted run, newest first."""
    from pyspark.sql import Window

    run = state.ordered_run(_orders(spark, d))
    return run.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))).select("key", "seq", "place")


def segment_min_max(spark, d):
    return statistics(_orders(spark, d), ["run"])


def prune_candidates(spark, d):
    o = _orders(spark, d).withColumn("run", F.floor(F.col("seq") / 1000))
    return candidates(statistics(o, ["run"]), "00000007").select("run", "min_key", "max_key")


def sparse_index_blocks(spark, d):
    return sparse_index(changes(spark, d), 64)


def sparse_index_lookup(spark, d):
    return block_of(sparse_index(changes(spark, d), 64), "user:42").select("block", "last_key")


def merge_runs(spark, d):
    o = _orders(spark, d)
    return state.live(state.merge_runs([o.where(F.col("run") == k).drop("run") for k in range(3)])).select("key", "seq", "value")


def compact_full(spark, d):
    return state.compacted(changes(spark, d), True).select("key", "seq", "op")


def compact_partial_keeps_tombstones(spark, d):
    return state.compacted(changes(spark, d), False).select("key", "seq", "op")


def compact_low_water(spark, d):
    return state.compacted(changes(spark, d), True, low_water=5000).select("key", "seq", "op")


def shadowed_versions(spark, d):
    return state.shadowed(changes(spark, d))


def dead_vector_bytes(spark, d):
    """Bytes in exported vector files that a plain overwrite of every third key leaves behind: vectors that the live
    rows of the log no longer point to."""
    path = _workspace(spark)
    v = _vectors(spark, d)
    key = F.concat(F.col("label").cast("string"), F.lit(":"), F.col("key").cast("string")).cast("binary").alias("key")
    first = v.select(F.col("key").alias("seq"), F.lit(PUT_VECTOR).cast("byte").alias("op"), key, F.lit(b"v").alias("value"), "vec")
    again = v.where("key % 3 = 0").select((F.col("key") + 1_000_000_000).alias("seq"), F.lit(0).cast("byte").alias("op"), key, F.lit(b"").alias("value"), F.lit(None).cast("array<float>").alias("vec"))
    logs.write_log(first.unionByName(again), path)
    records = logs.read_log(spark, path)
    size = F.when(F.octet_length("pointer") == 20, F.conv(F.hex(F.substring("pointer", 17, 4)), 16, 10).cast("long") * 4).otherwise(0)
    by_label = lambda rows, name: rows.groupBy(F.substring_index(F.col("key").cast("string"), ":", 1).cast("int").alias("label")).agg(F.sum(size).alias(name))
    return by_label(records, "all_bytes").join(by_label(state.live(records), "live_bytes"), "label").select("label", "all_bytes", (F.col("all_bytes") - F.col("live_bytes")).alias("dead_bytes"))


def vector_lookup(spark, d):
    """Pointers to a side table of vectors, some of them dangling."""
    v = _vectors(spark, d)
    pointers = v.select("key", F.col("key").alias("seq"), "label")
    blobs = v.where("key % 7 <> 0").select("key", F.col("key").alias("seq"), "vec")
    return lookup.dereference(pointers, blobs).select("key", "label", "dangling", F.coalesce(F.size("vec"), F.lit(0)).alias("dim"))


def wal_frame_bytes(spark, d):
    """Length of each encoded frame, every fifth with a vector's pointer, next to the size that is foretold."""
    log = changes(spark, d).select("seq", "op", F.col("key").cast("binary").alias("key"), _money("value").cast("binary").alias("value"), (F.col("seq") % 5 == 0).alias("vector"))
    pointer = F.when(F.col("vector"), F.unhex(F.lpad(F.hex("seq"), 40, "0")))
    return log.select("seq", F.octet_length(frame(F.col("op"), F.col("key"), F.col("value"), pointer)).cast("long").alias("bytes"), frame_bytes(F.col("key"), F.col("value"), F.col("vector")).cast("long").alias("foretold"))


def torn_tail_prefix(spark, d):
    """Logs of 1,000 records each, in which every frame whose seq ends in 777 has a damaged byte: replay of a log
    stops at its first bad frame for good."""
    log = changes(spark, d).select("seq", frame(F.col("op"), F.col("key"), _money("value")).alias("frame"), F.floor(F.col("seq") / 1000).alias("log"))
    files = log.groupBy("log").agg(F.sort_array(F.collect_list(F.struct("seq", "frame"))).alias("frames"))

    def replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for log_, frames in zip(df["log"], df["frames"]):
                whole = [bytes(f["frame"]) for f in frames]
                bad = [f[:-1] + bytes([f[-1] ^ 1]) if r["seq"] % 1000 == 777 else f for r, f in zip(frames, whole)]
                found = [(log_, int(frames[k]["seq"]), op, key.decode(), value.decode()) for k, (_, op, key, value, _) in enumerate(decode(b"".join(bad)))]
                yield pd.DataFrame(found, columns=["log", "seq", "op", "key", "value"])

    return files.mapInPandas(replayed, "log long, seq long, op byte, key string, value string")


def torn_log_repaired(spark, d):
    """A log with a torn tail, to which more is appended after its repair: all records of both are replayed."""
    path = _workspace(spark)
    log = changes(spark, d).select("seq", "op", F.col("key").cast("binary").alias("key"), _money("value").cast("binary").alias("value"))
    logs.write_log(log.where("seq < 300"), path)
    logs.write_log(log.where("seq >= 300 AND seq < 500"), f"{path}/more")
    folder, more = Folder(spark, path), Folder(spark, f"{path}/more")
    last = [n for n in folder.names() if n.endswith(".log")][-1]
    folder.write(last, folder.read(last) + bytes(range(1, 13)))
    logs.repair_log(spark, path)
    folder.write(last, folder.read(last) + b"".join(more.read(n) for n in more.names() if n.endswith(".log")))
    back = logs.read_log(spark, path)
    return back.groupBy(F.col("key").cast("string").alias("key")).agg(F.count("*").alias("versions"), F.sum(F.col("value").cast("string").cast("decimal(18,2)")).cast("double").alias("total"))


def log_round_trip(spark, d):
    """put_many without an order, deletions and vectors, exported as log and vector files and read again: the live rows."""
    path = _workspace(spark)
    store = Store.open(spark, f"{path}/store")
    o = _orders(spark, d).select(F.concat(F.lit("o"), F.col("seq").cast("string")).cast("binary").alias("key"), _money("value").cast("binary").alias("value"), F.when(F.col("seq") % 3 == 0, F.array(F.col("run").cast("float"), F.lit(0.5).cast("float"))).alias("vec"), "op")
    store.put_many(o.drop("op"))
    store.delete_many(o.where("op = 2"))
    logs.write_log(store.changelog(), f"{path}/export")
    back = state.live(logs.changes_of(logs.read_log(spark, f"{path}/export"), spark, f"{path}/export"))
    return back.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.coalesce(F.size("vec"), F.lit(0)).alias("dim"), F.get("vec", F.lit(0)).cast("double").alias("first"))


def table_round_trip(spark, d):
    """Newest versions written as sorted table files, tombstones and vectors too, and read again: the live rows."""
    path = _workspace(spark)
    o = _orders(spark, d).select("seq", F.when(F.col("op") == 0, F.when(F.col("seq") % 3 == 0, 1).otherwise(0)).otherwise(F.col("op")).cast("byte").alias("op"), F.col("key").cast("binary").alias("key"), _money("value").cast("binary").alias("value"), F.when((F.col("op") == 0) & (F.col("seq") % 3 == 0), F.array(F.col("run").cast("float"))).alias("vec"))
    logs.write_tables(state.latest(o), path)
    back = state.live(logs.changes_of(logs.read_tables(spark, path), spark, path))
    return back.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("vec").isNotNull().alias("has_vector"))


def table_point_get(spark, d):
    """Three keys asked of sorted table files by bounds, filter, index and one block: one that is there, a tombstone, and none."""
    path = _workspace(spark)
    log = changes(spark, d).select("seq", "op", F.col("key").cast("binary").alias("key"), _money("value").cast("binary").alias("value"))
    end = spark.createDataFrame([(1 << 50, 2, bytearray(b"user:9"), bytearray(b""))], log.schema)
    logs.write_tables(state.latest(log.unionByName(end)), path)
    asked = [logs.find_in_tables(spark, path, k).select(F.lit(k).alias("key"), F.col("value").cast("string").alias("value")) for k in ("user:7", "user:9", "user:none")]
    return asked[0].unionByName(asked[1]).unionByName(asked[2])


def group_commit_batches(spark, d):
    """events streamed into a store in commits of at most 1,000 requests: what each commit holds."""
    path = _workspace(spark)
    _binary(changes(spark, d)).repartitionByRange(4, "seq").write.parquet(f"{path}/incoming")
    store = Store.open(spark, f"{path}/store")
    stream = spark.readStream.schema(CHANGELOG).parquet(f"{path}/incoming")
    ingest(stream, store, "events", f"{path}/offsets", most=1000).awaitTermination()
    rows = [(s.rows, s.min_seq, s.max_seq) for s in store.refresh().manifest.segments]
    return spark.createDataFrame(rows, "requests long, first_seq long, last_seq long")


def service_verbs(spark, d):
    """put, put_vector, delete, get and query of single keys, over a store with a bulk load."""
    store = Store.open(spark, f"{_workspace(spark)}/store")
    store.append(_binary(changes(spark, d)))
    store.put("user:1", "put")
    store.put_vector("user:2", "with", [1.0, 2.5])
    store.put("user:2", "without")
    store.put_vector("user:3", "vector", [0.5])
    store.put("user:4", "")
    store.delete("user:5")
    keys = [f"user:{k}" for k in (1, 2, 3, 4, 5)] + ["none"]
    out = []
    for k in keys:
        value, found = store.get(k), store.query(k)
        out.append((k, None if value is None else value.decode(), None if found is None else len(found[1] or [])))
    return spark.createDataFrame(out, "key string, value string, dim int")


def bulk_verbs(spark, d):
    """put_many with an order, delete_many, and what is left alive."""
    store = Store.open(spark, f"{_workspace(spark)}/store")
    log = _binary(changes(spark, d))
    store.put_many(log.select("key", "value", "seq"), order="seq")
    store.delete_many(log.where("op = 2").select("key"))
    store.put_many(log.where("seq % 97 = 0").select("key", F.lit("again").cast("binary").alias("value"), "seq"), order="seq")
    return store.live().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def compaction_trigger(spark, d):
    """Appends until the store says that a compaction is due: level-0 segments, rows and tombstones after each."""
    store = Store.open(spark, f"{_workspace(spark)}/store")
    log, out = _binary(changes(spark, d)), []
    for k in range(5):
        store.append(log.where(F.col("seq") % 5 == k))
        due = store.compact_if_needed()
        s = store.statistics()
        out.append((k, due, s["segments"], s["rows"], s["tombstones"]))
    return spark.createDataFrame(out, "append int, compacted boolean, segments int, rows long, tombstones long")


def _topk(metric):
    def run(spark, d):
        v = _vectors(spark, d)
        q = v.agg(F.min_by("vec", "key")).first()[0]
        return top_k(v, q, 10, metric).select("key", F.round("score", 6).alias("score"))

    return run


def batch_vector_topk(spark, d):
    v = _vectors(spark, d)
    queries = v.where("key % 20 = 0").select(F.col("key").alias("query_id"), F.col("vec").alias("query_vec"))
    return batch_top_k(v, queries, 3).select("query_id", "key", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


def as_of_snapshot(spark, d):
    return state.as_of(changes(spark, d), 5000).select("key", "seq", "value")


def crc32_frames(spark, d):
    """The checksum in the header of every record's frame, with key, value and op: unsigned."""
    whole = changes(spark, d).select("seq", frame(F.col("op"), F.col("key"), _money("value")).alias("frame"))
    return whole.select("seq", F.conv(F.hex(F.substring("frame", 1, 4)), 16, 10).cast("long").alias("crc"))


def stream_ingest_live(spark, d):
    """events streamed into a store in micro-batches, then its live rows."""
    path = _workspace(spark)
    log = _binary(changes(spark, d))
    log.repartition(4).write.parquet(f"{path}/incoming")
    store = Store.open(spark, f"{path}/store")
    stream = spark.readStream.schema(CHANGELOG).option("maxFilesPerTrigger", 2).parquet(f"{path}/incoming")
    ingest(stream, store, "events", f"{path}/offsets").awaitTermination()
    return _text(store.refresh().live())


def store_compacted_live(spark, d):
    """Two batches, a flush and a full compaction; the live rows must not change."""
    store = Store.open(spark, f"{_workspace(spark)}/store")
    log = _binary(changes(spark, d))
    store.append(log.where("seq % 2 = 0"))
    store.append(log.where("seq % 2 = 1"))
    store.flush()
    store.compact()
    return _text(store.live())


def bloom_no_false_negative(spark, d):
    """Every live key is found again in a sorted segment with a bloom filter."""
    store = Store.open(spark, f"{_workspace(spark)}/store")
    store.append(_binary(changes(spark, d)))
    store.flush()
    keys = state.live(_binary(changes(spark, d))).select("key")
    return store.multi_get(keys).select(F.col("key").cast("string").alias("key"), "seq")


QUERIES = [
    lww_live, lww_live_narrow, tombstoned_keys, delete_then_revive, point_get, point_get_absent, point_get_deleted, multi_get, range_scan, prefix_scan,
    empty_value_vs_tombstone, vector_overwritten_by_plain_put, tier_precedence, ordered_run, segment_min_max, prune_candidates, sparse_index_blocks,
    sparse_index_lookup, merge_runs, compact_full, compact_partial_keeps_tombstones, compact_low_water, shadowed_versions, dead_vector_bytes, vector_lookup,
    wal_frame_bytes, torn_tail_prefix, group_commit_batches, batch_vector_topk, as_of_snapshot, crc32_frames, stream_ingest_live, store_compacted_live,
    bloom_no_false_negative, torn_log_repaired, log_round_trip, table_round_trip, table_point_get, service_verbs, bulk_verbs, compaction_trigger,
]


def queries():
    return {f.__name__: f for f in QUERIES} | {f"vector_topk_{m}": _topk(m) for m in ("cosine", "l2", "dot")}


# SQL

_LOG = "WITH c AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS op, 'user:' || user_id AS key, value FROM events)"
_NEW = f"{_LOG}, n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"
_ORDERS = "WITH o AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 0 END AS op, lpad(o_custkey::VARCHAR, 8, '0') AS key, o_totalprice AS value, (o_orderkey % 3)::INTEGER AS run FROM orders)"
_STATS = "count(*) AS rows, min(key) AS min_key, max(key) AS max_key, min(seq) AS min_seq, max(seq) AS max_seq, count(*) FILTER (op = 2) AS tombstones"
_BLOCKS = f"{_LOG}, b AS (SELECT *, (row_number() OVER (ORDER BY key, seq DESC) - 1) // 64 AS block FROM c), x AS (SELECT block, min(key) AS first_key, max(key) AS last_key, count(*) AS rows FROM b GROUP BY 1)"
_LIVE = f"{_NEW} SELECT key, seq, value FROM n WHERE op = 0"
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


#: Checksums over the bytes of each frame's payload: the table by eight steps per entry, then one step per byte.
_CRC = f"""{_LOG}, t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, i)) AS step),
p AS (SELECT seq, list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT) AS k, list_transform(string_split(value::DECIMAL(18,2)::VARCHAR, ''), lambda x: ord(x)::BIGINT) AS v, op FROM c),
b AS (SELECT seq, list_concat([op::BIGINT, 0, 0, 0, len(k), 0, 0, 0, len(v), 0, 0, 0, 0], list_concat(k, v)) AS bytes FROM p)
SELECT seq, xor(list_reduce(bytes, lambda x, y: xor(x // 256, step[xor(x % 256, y) + 1]), 4294967295::BIGINT), 4294967295) AS crc FROM b, t"""


def _topk_sql(function: str, direction: str) -> str:
    return f"SELECT vec_id AS key, round({function}(embedding::DOUBLE[], {_Q}::DOUBLE[]), 6) AS score FROM embeddings ORDER BY {function}(embedding::DOUBLE[], {_Q}::DOUBLE[]) {direction}, vec_id LIMIT 10"


def oracle_sql():
    return {
        "lww_live": _LIVE, "lww_live_narrow": _LIVE, "stream_ingest_live": _LIVE.replace("SELECT key, seq, value FROM", "SELECT seq, key, value FROM"), "store_compacted_live": _LIVE,
        "tombstoned_keys": f"{_NEW} SELECT key, seq FROM n WHERE op = 2",
        "delete_then_revive": f"{_LOG} SELECT key, seq, value FROM c QUALIFY op = 0 AND lag(op) OVER (PARTITION BY key ORDER BY seq) = 2",
        "point_get": f"{_NEW} SELECT value FROM n WHERE op = 0 AND key = 'user:7'",
        "point_get_absent": f"{_NEW} SELECT value FROM n WHERE op = 0 AND key = 'user:none'",
        "point_get_deleted": f"{_NEW} SELECT value FROM n WHERE false",
        "multi_get": f"{_NEW} SELECT key, seq, value FROM n WHERE op = 0 AND key IN (SELECT 'user:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
        "range_scan": f"{_NEW} SELECT key, seq, value FROM n WHERE op = 0 AND key >= 'user:1' AND key < 'user:2'",
        "prefix_scan": f"{_NEW} SELECT key, seq, value FROM n WHERE op = 0 AND starts_with(key, 'user:10')",
        "empty_value_vs_tombstone": "WITH c AS (SELECT event_id AS seq, event_type, user_id AS key, CASE WHEN event_type = 'purchase' THEN '' ELSE value::DECIMAL(18,2)::VARCHAR END AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) SELECT key, length(value) AS value_length, value = '' AS is_empty FROM c WHERE event_type <> 'error'",
        "vector_overwritten_by_plain_put": "SELECT vec_id AS key, CASE WHEN vec_id % 3 = 0 THEN 'plain' ELSE label::VARCHAR END AS value, vec_id % 3 <> 0 AS has_vector FROM embeddings",
        "tier_precedence": f"{_ORDERS}, t AS (SELECT *, 2 - run AS tier FROM o QUALIFY row_number() OVER (PARTITION BY key, run ORDER BY seq DESC) = 1), h AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY key ORDER BY tier) = 1) SELECT key, seq, value, tier::INTEGER AS tier FROM h WHERE op = 0",
        "ordered_run": f"{_ORDERS} SELECT key, seq, (row_number() OVER (PARTITION BY key ORDER BY seq DESC))::INTEGER AS place FROM o",
        "segment_min_max": f"{_ORDERS} SELECT run, {_STATS} FROM o GROUP BY run",
        "prune_candidates": f"{_ORDERS}, s AS (SELECT seq // 1000 AS run, min(key) AS min_key, max(key) AS max_key FROM o GROUP BY 1) SELECT * FROM s WHERE min_key <= '00000007' AND max_key >= '00000007'",
        "sparse_index_blocks": f"{_BLOCKS} SELECT * FROM x",
        "sparse_index_lookup": f"{_BLOCKS} SELECT block, last_key FROM x WHERE last_key >= 'user:42' ORDER BY block LIMIT 1",
        "merge_runs": f"{_ORDERS}, n AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT key, seq, value FROM n WHERE op = 0",
        "compact_full": f"{_NEW} SELECT key, seq, op::TINYINT AS op FROM n WHERE op = 0",
        "compact_partial_keeps_tombstones": f"{_NEW} SELECT key, seq, op::TINYINT AS op FROM n",
        "compact_low_water": f"{_NEW} SELECT key, seq, op::TINYINT AS op FROM n WHERE op = 0 OR seq > 5000",
        "shadowed_versions": f"{_LOG} SELECT key, count(*) AS versions, count(*) - 1 AS dead FROM c GROUP BY key",
        "dead_vector_bytes": "SELECT label, sum(len(embedding) * 4)::BIGINT AS all_bytes, sum(CASE WHEN vec_id % 3 = 0 THEN len(embedding) * 4 ELSE 0 END)::BIGINT AS dead_bytes FROM embeddings GROUP BY label",
        "vector_lookup": "SELECT vec_id AS key, label, vec_id % 7 = 0 AS dangling, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE len(embedding)::INTEGER END AS dim FROM embeddings",
        "wal_frame_bytes": f"{_LOG} SELECT seq, (21 + octet_length(encode(key)) + length(value::DECIMAL(18,2)::VARCHAR) + CASE WHEN seq % 5 = 0 THEN 20 ELSE 0 END)::BIGINT AS bytes, bytes AS foretold FROM c",
        "torn_tail_prefix": f"{_LOG} SELECT seq // 1000 AS log, seq, op::TINYINT AS op, key, value::DECIMAL(18,2)::VARCHAR AS value FROM c WHERE seq % 1000 < 777",
        "torn_log_repaired": f"{_LOG} SELECT key, count(*) AS versions, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM c WHERE seq < 500 GROUP BY key",
        "log_round_trip": "SELECT 'o' || o_orderkey AS key, o_totalprice::DECIMAL(18,2)::VARCHAR AS value, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END::INTEGER AS dim, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 END::DOUBLE AS first FROM orders WHERE o_orderkey % 10 <> 0",
        "table_round_trip": f"{_ORDERS}, n AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT key, value::DECIMAL(18,2)::VARCHAR AS value, seq % 3 = 0 AS has_vector FROM n WHERE op = 0",
        "table_point_get": f"{_NEW} SELECT key, value::DECIMAL(18,2)::VARCHAR AS value FROM n WHERE op = 0 AND key = 'user:7'",
        "group_commit_batches": "WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events) SELECT count(*) AS requests, min(event_id) AS first_seq, max(event_id) AS last_seq FROM n GROUP BY r // 1000",
        "service_verbs": "SELECT * FROM (VALUES ('user:1', 'put', 0), ('user:2', 'without', 0), ('user:3', 'vector', 1), ('user:4', '', 0), ('user:5', NULL, NULL), ('none', NULL, NULL)) AS t(key, value, dim)",
        "bulk_verbs": f"{_NEW}, dead AS (SELECT DISTINCT key FROM c WHERE op = 2), again AS (SELECT DISTINCT key FROM c WHERE seq % 97 = 0) SELECT key, CASE WHEN key IN (SELECT key FROM again) THEN 'again' ELSE value::VARCHAR END AS value FROM n WHERE key IN (SELECT key FROM again) OR key NOT IN (SELECT key FROM dead)",
        "compaction_trigger": f"{_LOG}, a AS (SELECT i::INTEGER AS append, i = 3 AS compacted, CASE WHEN i < 3 THEN i + 1 ELSE i - 2 END::INTEGER AS segments FROM range(5) AS r(i)), w AS (SELECT *, seq % 5 AS part FROM c), z AS (SELECT * FROM w WHERE part < 4 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT append, compacted, segments, CASE WHEN append < 3 THEN (SELECT count(*) FROM w WHERE part <= append) ELSE (SELECT count(*) FROM z WHERE op = 0) + CASE WHEN append = 4 THEN (SELECT count(*) FROM w WHERE part = 4) ELSE 0 END END AS rows, CASE WHEN append < 3 THEN (SELECT count(*) FROM w WHERE part <= append AND op = 2) WHEN append = 3 THEN 0 ELSE (SELECT count(*) FROM w WHERE part = 4 AND op = 2) END AS tombstones FROM a",
        "crc32_frames": _CRC,
        "vector_topk_cosine": _topk_sql("list_cosine_similarity", "DESC"),
        "vector_topk_l2": _topk_sql("list_distance", "ASC"),
        "vector_topk_dot": _topk_sql("list_inner_product", "DESC"),
        "batch_vector_topk": "WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS key, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) AS place FROM p) SELECT query_id, key, round(s, 6) AS score, place FROM r WHERE place <= 3",
        "as_of_snapshot": f"{_LOG}, n AS (SELECT * FROM c WHERE seq <= 5000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT key, seq, value FROM n WHERE op = 0",
        "bloom_no_false_negative": f"{_NEW} SELECT key, seq FROM n WHERE op = 0",
    }
