"""The store against a plain dictionary, and one test per rule of the contract."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import lookup
from ridgeline.sources.files import Folder
from ridgeline.sources.store import Conflict, Store


def everything(store):
    return {bytes(r["key"]): (bytes(r["value"]), r["vec"]) for r in store.live().collect()}


def rows(spark, pairs):
    return spark.createDataFrame([(k.encode(), v.encode(), n) for n, (k, v) in enumerate(pairs)], "key binary, value binary, n long")


@pytest.fixture
def store(spark, tmp_path):
    return Store.open(spark, str(tmp_path / "store"))


def test_random_operations_match_a_dictionary(spark, tmp_path):
    rng, path = random.Random(5), str(tmp_path / "s")
    store, model = Store.open(spark, path), {}
    for _ in range(14):
        what = rng.choice(["put", "put", "put", "delete", "vector", "flush", "compact", "partial", "reopen"])
        keys = [f"k{rng.randrange(12)}" for _ in range(rng.randrange(1, 8))]
        if what == "put":
            batch = [(k, f"v{rng.random()}") for k in keys]
            store.put_many(rows(spark, batch), order="n")
            model |= {k.encode(): (v.encode(), None) for k, v in batch}
        elif what == "delete":
            store.delete_many(rows(spark, [(k, "") for k in keys]))
            for k in keys:
                model.pop(k.encode(), None)
        elif what == "vector":
            store.put_vector(keys[0], "vec", [1.0, 2.5])
            model[keys[0].encode()] = (b"vec", [1.0, 2.5])
        elif what == "flush":
            store.flush()
        elif what == "compact":
            store.compact()
        elif what == "partial":
            store.compact(full=False)
        else:
            store = Store.open(spark, path)
        if what in ("compact", "partial", "reopen", "delete"):
            assert everything(store) == model
    assert everything(store) == model


def test_service_verbs(store):
    assert store.get("a") is None
    assert store.put("a", "1") and store.get("a") == b"1"
    assert store.put("a", "") and store.get("a") == b"", "an empty value is live"
    assert store.delete("a") and store.get("a") is None
    assert store.put("a", "2") and store.get("a") == b"2", "a put after a delete revives"
    assert not store.put("a", None) and not store.put(None, "x") and store.get(None) is None and not store.delete(None)
    with pytest.raises(ValueError):
        store.put_vector("a", "x", [])
    store.put("", "empty key")
    assert store.get("") == b"empty key"


def test_plain_put_erases_the_vector(store):
    store.put_vector("a", "1", [1.0])
    assert store.query("a") == (b"1", [1.0])
    store.put("a", "2")
    assert store.query("a") == (b"2", None)


def test_keys_order_as_unsigned_bytes(spark, store):
    keys = [b"", b"\x61", b"\x61\x62", b"\x7f", b"\x80", b"\xff\x00"]
    store.put_many(spark.createDataFrame([(bytearray(k), bytearray(b"x")) for k in reversed(keys)], "key binary, value binary"))
    store.flush()
    s = store.manifest.segments[0]
    assert (s.min_key, s.max_key) == ("", "ff00")
    assert [bytes(r["key"]) for r in store.live().orderBy("key").collect()] == keys
    assert {bytes(r["key"]) for r in store.range(b"\x61", b"\x80").collect()} == {b"\x61", b"\x61\x62", b"\x7f"}
    assert {bytes(r["key"]) for r in store.prefix(b"\xff").collect()} == {b"\xff\x00"}


def test_partial_compaction_keeps_tombstones(store):
    store.put("a", "1")
    store.compact()  # the put is now in an older segment
    store.delete("a")
    store.compact(full=False)
    assert store.statistics()["tombstones"] == 1 and store.get("a") is None
    store.compact()
    assert store.statistics() == {"segments": 0, "rows": 0, "tombstones": 0} and store.get("a") is None


def test_low_water_keeps_young_tombstones(store):
    store.put("a", "1")
    store.delete("a")
    store.compact(low_water=0)
    assert store.statistics()["tombstones"] == 1


def test_second_writer_conflicts(spark, store):
    other = Store.open(spark, store.path)
    store.put("a", "1")
    with pytest.raises(Conflict):
        other.put("a", "2")
    other.refresh().put("a", "3")
    assert store.refresh().get("a") == b"3"


def test_unpublished_segments_are_invisible(spark, store):
    store.put("a", "1")
    spark.createDataFrame([(9 << 40, 0, bytearray(b"a"), bytearray(b"bad"), None)], "seq long, op byte, key binary, value binary, vec array<float>").write.parquet(f"{store.path}/segments/stray")
    assert Store.open(spark, store.path).get("a") == b"1"
    assert "stray" in store.vacuum(older_than_seconds=0) and store.get("a") == b"1"


def test_replayed_batch_is_applied_once(spark, store):
    batch = spark.createDataFrame([(1, 0, bytearray(b"a"), bytearray(b"1"), None)], "seq long, op byte, key binary, value binary, vec array<float>")
    assert store.append(batch, source="s", batch_id=0)
    assert not store.append(batch, source="s", batch_id=0)
    assert store.statistics()["rows"] == 1


def test_null_key_is_rejected(spark, store):
    with pytest.raises(Exception, match="key must not be null"):
        store.put_many(spark.createDataFrame([(None, bytearray(b"x"))], "key binary, value binary"))
    assert everything(store) == {}


def test_two_versions_with_one_seq_are_rejected_on_demand(spark, store):
    twice = rows(spark, [("a", "1"), ("b", "2"), ("a", "3")])
    with pytest.raises(ValueError, match="order"):
        store.put_many(twice, verify=True)
    assert everything(store) == {} and store.vacuum(older_than_seconds=0) == []
    assert store.put_many(twice, order="n", verify=True)
    assert store.get("a") == b"3"


def test_as_of(store):
    store.put("a", "1")
    at = store.manifest.segments[-1].max_seq
    store.put("a", "2")
    assert [bytes(r["value"]) for r in store.as_of(at).collect()] == [b"1"]


def test_search_vector(store):
    for k, v in (("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("zero", [0.0, 0.0]), ("long", [1.0, 0.0, 0.0])):
        store.put_vector(k, k, v)
    store.put("plain", "no vector")
    got = [(bytes(r["key"]), round(r["score"], 6)) for r in store.search_vector([1.0, 0.0], 10).collect()]
    assert got == [(b"a", 1.0), (b"b", 1.0), (b"c", 0.0)]
    assert store.search_vector([1.0, 0.0], 0).count() == 0
    assert [bytes(r["key"]) for r in store.search_vector([0.0, 0.9], 1, "l2").collect()] == [b"c"]


def test_point_lookup_reaches_the_scan(store):
    for k in ("a", "b"):
        store.put(k, "1")
    store.flush()
    from ridgeline.operators.lookup import get

    plan = get(store.changelog(key="a"), "a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in plan and "vec" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert store.changelog(key="zz").isEmpty(), "no segment can hold it"


def test_a_compacted_base_is_not_shuffled(spark, store):
    store.put_many(rows(spark, [(f"k{i}", "old") for i in range(50)]))
    store.compact()
    plan = lambda: store.live()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan() and "Window" not in plan()
    store.put_many(rows(spark, [("k1", "new"), ("k60", "new")]))
    store.delete("k2")
    late = spark.createDataFrame([(0, 0, bytearray(b"k3"), bytearray(b"late"), None)], "seq long, op byte, key binary, value binary, vec array<float>")
    store.append(late)  # arrives late with an older seq
    got = {k.decode(): v.decode() for k, (v, _) in everything(store).items()}
    assert got == {f"k{i}": "old" for i in range(50) if i != 2} | {"k1": "new", "k60": "new"}
    assert "BroadcastHashJoin" in plan()
    before = everything(store)
    lookup.BROADCAST_BYTES, limit = 0, lookup.BROADCAST_BYTES
    try:
        assert everything(store) == before
    finally:
        lookup.BROADCAST_BYTES = limit


def test_compaction_trigger(store):
    for k in range(4):
        assert not store.compact_if_needed()
        store.put(f"k{k}", "v")
    assert store.compact_if_needed() and len(store.manifest.segments) == 1


def test_many_writes_of_one_key(spark, store):
    hot = spark.range(5000).select(F.lit(b"hot").alias("key"), F.col("id").cast("string").cast("binary").alias("value"), "id")
    store.put_many(hot, order="id")
    assert store.get("hot") == b"4999"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_hold_no_single_partition(spark, tmp_path):
    from ridgeline.operators.segments import sparse_index
    from ridgeline.operators.vector import batch_top_k
    from ridgeline.plans.state import ordered_run

    spark.range(1000).selectExpr("concat('k', id % 10) AS key", "id AS seq", "array(cast(id AS float), cast(1 AS float)) AS vec").write.parquet(str(tmp_path / "t"))
    log = spark.read.parquet(str(tmp_path / "t"))
    assert "SinglePartition" not in plan(sparse_index(log, 64))
    assert "rangepartitioning(key" in plan(ordered_run(log)) and "seq" in plan(ordered_run(log)).split("rangepartitioning(")[1].split(")")[0]
    queries = log.where("seq % 3 = 0").selectExpr("seq AS query_id", "vec AS query_vec")
    for block in (1024, 16):
        found = batch_top_k(log.selectExpr("seq AS key", "vec"), queries, 2, "l2", block=block)
        assert plan(found).count("FileScan parquet") == 2, "one for the rows, one for the queries"
        got = {(r["query_id"], r["place"]): r["key"] for r in found.collect()}
        assert len(got) == 2 * 334 and all(got[q, 1] == q for q in range(0, 1000, 3)) and all(got[q, 2] == (q - 1 if q else 1) for q in range(0, 1000, 3))


def test_numbers_over_ranges(spark):
    from ridgeline.plans.state import numbered

    rows = spark.range(5000).selectExpr("id % 3 AS hot", "id").repartition(7)
    got = numbered(rows, F.col("hot"), F.col("id").desc()).collect()
    want = sorted(((r["hot"], r["id"]) for r in got), key=lambda x: (x[0], -x[1]))
    assert [(r["hot"], r["id"]) for r in sorted(got, key=lambda r: r["number"])] == want and sorted(r["number"] for r in got) == list(range(5000))
    assert numbered(rows.limit(0), "id").count() == 0


def test_versions_of_one_key_are_shared_out(spark):
    from ridgeline.plans.state import merge_runs, ordered_run

    hot = spark.range(20_000).selectExpr("'hot' AS key", "id AS seq")
    sizes = [r["n"] for r in ordered_run(hot, partitions=4).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 10_000
    run = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "key string, seq long, value string")
    again = spark.createDataFrame([("a", 2, "z"), ("b", 1, "w")], "key string, seq long, value string")
    assert sorted(map(tuple, merge_runs([run, again]).collect())) == [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "w")]


def test_a_flush_beside_a_writer(spark, store):
    """A flush that is overtaken by appends keeps them; one whose segments are gone gives up."""
    store.put("a", "1")
    other = Store.open(spark, store.path)
    store.put("b", "2")
    assert other.flush() and {bytes(k) for k in everything(store.refresh())} == {b"a", b"b"}
    late = Store.open(spark, store.path)
    store.compact()
    with pytest.raises(Conflict):
        late.flush()
    assert len(everything(store.refresh())) == 2


def test_commits_of_a_bounded_size(spark, store):
    batch = rows(spark, [(f"k{i}", str(i)) for i in range(25)]).selectExpr("n AS seq", "cast(0 AS byte) AS op", "key", "value", "cast(null AS array<float>) AS vec")
    assert store.append_bounded(batch, 10, "s", 0) == 3 and [s.rows for s in store.manifest.segments] == [10, 10, 5]
    assert store.append_bounded(batch, 10, "s", 0) == 0 and store.append_bounded(batch, 10, "s", 1) == 3


def numbers(spark, n):
    return spark.range(n).selectExpr("id AS seq", "cast(0 AS byte) AS op", "cast(concat('k', id) AS binary) AS key", "cast(cast(id AS string) AS binary) AS value", "cast(null AS array<float>) AS vec")


def test_many_bounded_commits_need_no_more_jobs(spark, tmp_path):
    def jobs(commits):
        spark.sparkContext.setJobGroup(f"commits-{commits}", "")
        store = Store.open(spark, str(tmp_path / str(commits)))
        assert store.append_bounded(numbers(spark, 240), 240 // commits, "s", 0) == commits
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"commits-{commits}"))

    assert jobs(48) <= jobs(6) + 2


def test_every_bounded_commit_is_a_version_of_its_own(spark, store):
    store.append_bounded(numbers(spark, 300), 1, "s", 0)
    files = [n for n in store._manifests.names() if n.endswith(".json")]
    assert len(files) == 300 and [s.min_seq for s in store.manifest.segments] == list(range(300))
    listed = [len(json.loads(store._manifests.read(n))["segments"]) for n in files]
    assert sum(listed) < 300 * 301 / 2 / 3, "most versions list only what they add to an older one"
    assert Store.open(spark, store.path).manifest == store.manifest and store.manifest.base > 0
    assert store.vacuum(older_than_seconds=0) == [] and Store.open(spark, store.path).manifest == store.manifest
    assert len(everything(store)) == 300 and store.get("k7") is not None and set(store.live().columns) == {"seq", "op", "key", "value", "vec"}
    assert store.flush() and Store.open(spark, store.path).manifest == store.manifest
    assert len(store.vacuum(older_than_seconds=0)) == 1 and len(everything(Store.open(spark, store.path))) == 300


def test_bounded_commits_go_on_where_they_were_cut_off(spark, store, monkeypatch):
    publish, calls = Store._publish, []

    def failing(self, new):
        calls.append(new)
        if len(calls) == 3:
            raise OSError("no space")
        publish(self, new)

    monkeypatch.setattr(Store, "_publish", failing)
    with pytest.raises(OSError, match="no space"):
        store.append_bounded(numbers(spark, 25), 5, "s", 0)
    assert [s.rows for s in Store.open(spark, store.path).manifest.segments] == [5, 5]
    assert store.refresh().append_bounded(numbers(spark, 25), 5, "s", 0) == 3 and [s.min_seq for s in store.manifest.segments] == [0, 5, 10, 15, 20]
    gone = store.vacuum(older_than_seconds=0)
    assert len(gone) == 3 and len(everything(store)) == 25, "what the first attempt wrote and never published"


def test_others_publish_between_bounded_commits(spark, store, monkeypatch):
    publish, calls = Store._publish, []

    def beside(self, new):
        calls.append(new)
        if len(calls) == 3:
            monkeypatch.setattr(Store, "_publish", publish)
            assert Store.open(spark, store.path).flush()
        publish(self, new)

    monkeypatch.setattr(Store, "_publish", beside)
    assert store.append_bounded(numbers(spark, 25), 5, "s", 0) == 5
    assert [(s.level, s.rows) for s in store.manifest.segments] == [(1, 10), (0, 5), (0, 5), (0, 5)] and len(everything(store)) == 25

    def twin(self, new):
        monkeypatch.setattr(Store, "_publish", publish)
        Store.open(spark, store.path).append_bounded(numbers(spark, 25), 5, "s", 1)
        publish(self, new)

    monkeypatch.setattr(Store, "_publish", twin)
    with pytest.raises(Conflict):
        store.append_bounded(numbers(spark, 25), 5, "s", 1)
    assert store.refresh().append_bounded(numbers(spark, 25), 5, "s", 1) == 0 and store.statistics()["rows"] == 50


@pytest.mark.parametrize("links", [True, False])
def test_a_new_file_replaces_none(spark, tmp_path, monkeypatch, links):
    if not links:
        monkeypatch.setattr(os, "link", lambda *_: (_ for _ in ()).throw(OSError("no links here")))
    folder = Folder(spark, str(tmp_path / "f"))
    assert folder.add("a", b"1") and not folder.add("a", b"2")
    assert folder.read("a") == b"1" and [n for n in folder.names() if not n.startswith(".")] == ["a"]
