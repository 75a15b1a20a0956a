"""Every registered query of the engine against its SQL."""

import duckdb
import pytest

from ridgeline import queries as registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(table, columns):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, db, name):
    df = registry.queries()[name](spark, DATA)
    want = db.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows(df.select(*columns).collect(), columns) == rows(want.project(quoted).fetchall(), columns)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_crc32(spark):
    """The same checksums as a library gives, of the frame that a library call makes."""
    from ridgeline.functions.frames import HEADER, encode

    events = {r["event_id"]: r for r in spark.read.parquet(f"{DATA}/events.parquet").selectExpr("event_id", "user_id", "event_type", "cast(cast(value AS decimal(18,2)) AS string) AS value").collect()}
    for r in registry.crc32_frames(spark, DATA).collect():
        e = events[r["seq"]]
        whole = encode(2 if e["event_type"] == "error" else 0, f"user:{e['user_id']}".encode(), e["value"].encode())
        assert r["crc"] == HEADER.unpack_from(whole)[0]
