from ridgeline.schema import CHANGELOG
from ridgeline.sources.store import Store
from ridgeline.streaming.ingest import Maintenance, ingest, live_view


def batch(spark, first, n):
    return spark.createDataFrame([(first + i, 2 if i % 4 == 3 else 0, bytearray(f"k{i % 5}".encode()), bytearray(str(first + i).encode()), None) for i in range(n)], CHANGELOG)


def test_restart_goes_on_where_it_was(spark, tmp_path):
    incoming, store = str(tmp_path / "in"), Store.open(spark, str(tmp_path / "store"))
    batch(spark, 0, 10).write.parquet(incoming)
    stream = lambda: spark.readStream.schema(CHANGELOG).parquet(incoming)
    for _ in range(2):
        ingest(stream(), store, "s", str(tmp_path / "offsets"), flush_every=1).awaitTermination()
    assert store.refresh().statistics()["rows"] == 10
    batch(spark, 100, 10).write.mode("append").parquet(incoming)
    ingest(stream(), store, "s", str(tmp_path / "offsets")).awaitTermination()
    assert store.refresh().statistics()["rows"] == 20
    assert max(int(bytes(r["value"])) for r in store.live().collect()) == 109


def test_live_view(spark, tmp_path):
    batch(spark, 0, 10).write.parquet(str(tmp_path / "in"))
    q = live_view(spark.readStream.schema(CHANGELOG).parquet(str(tmp_path / "in")), "newest", str(tmp_path / "offsets"))
    q.awaitTermination()
    got = {bytes(r["key"]).decode(): int(bytes(r["value"])) for r in spark.table("newest").collect()}
    assert got == {"k0": 5, "k1": 6, "k3": 8, "k4": 9}


def test_maintenance_beside_the_stream(spark, tmp_path):
    incoming, store = str(tmp_path / "in"), Store.open(spark, str(tmp_path / "store"))
    for k in range(6):
        batch(spark, 100 * k, 10).coalesce(1).write.mode("append").parquet(incoming)
    beside = Maintenance(store, compact=True)
    stream = spark.readStream.schema(CHANGELOG).option("maxFilesPerTrigger", 1).parquet(incoming)
    ingest(stream, store, "s", str(tmp_path / "offsets"), flush_every=1, most=4, maintenance=beside).awaitTermination()
    beside.wait()
    store.refresh()
    assert any(s.level for s in store.manifest.segments)
    got = {bytes(r["key"]).decode(): int(bytes(r["value"])) for r in store.live().collect()}
    assert got == {"k0": 505, "k1": 506, "k3": 508, "k4": 509}
