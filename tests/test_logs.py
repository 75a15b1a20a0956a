import struct

from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.functions.frames import decode, encode, valid_length
import io
import random

import pytest

from ridgeline.functions import tables
from ridgeline.sources.logs import changes_of, find_in_tables, read_log, read_tables, repair_log, vectors_of, write_log, write_tables

records = st.lists(st.tuples(st.integers(0, 2), st.binary(max_size=20), st.binary(max_size=20), st.sampled_from([b"", bytes(20)])), max_size=8)


@given(records, st.binary(max_size=30))
@settings(max_examples=60, deadline=None)
def test_round_trip_with_a_torn_tail(rows, junk):
    data = b"".join(encode(*r) for r in rows)
    assert [tuple(x[1:]) for x in decode(data)] == rows and valid_length(data) == len(data)
    assert [tuple(x[1:]) for x in decode(data + junk)][: len(rows)] == rows


def test_replay_stops_at_the_first_bad_frame():
    good, bad = encode(0, b"a", b"1"), bytearray(encode(0, b"b", b"2"))
    bad[-1] ^= 1
    assert len(list(decode(good + bytes(bad) + good))) == 1
    assert valid_length(good + bytes(bad)) == len(good)
    for tail in (b"\x01\x02\x03", good[:9], struct.pack(">II", 1, 200 << 20) + b"x" * 50, bytes(range(1, 13))):
        assert valid_length(good + tail) == len(good)


def test_log_files(spark, tmp_path):
    (tmp_path / "wal_2.log").write_bytes(encode(2, b"k", b""))
    (tmp_path / "wal_1.log").write_bytes(encode(0, b"k", b"v") + encode(1, b"w", b"x", struct.pack(">qqi", 0, 4, 2)) + b"torn")
    (tmp_path / "vlog-0.data").write_bytes(struct.pack(">3f", 9.0, 1.5, 2.5))
    log = read_log(spark, str(tmp_path))
    assert [(bytes(r["key"]), r["op"]) for r in log.orderBy("seq").collect()] == [(b"k", 0), (b"w", 1), (b"k", 2)]
    got = {bytes(r["key"]): r["vec"] for r in vectors_of(log.where("op <> 2"), spark, str(tmp_path)).collect()}
    assert got == {b"k": None, b"w": [1.5, 2.5]}


def test_dangling_pointer(spark, tmp_path):
    (tmp_path / "wal_1.log").write_bytes(encode(1, b"w", b"x", struct.pack(">qqi", 7, 0, 2)) + encode(1, b"y", b"x", struct.pack(">qqi", 0, 0, 9)))
    (tmp_path / "vlog-0.data").write_bytes(struct.pack(">2f", 1.0, 2.0))
    assert [r["vec"] for r in vectors_of(read_log(spark, str(tmp_path)), spark, str(tmp_path)).collect()] == [None, None]


def test_export_and_import(spark, tmp_path):
    rows = spark.range(100).selectExpr("id AS seq", "cast(id % 3 AS byte) AS op", "cast(concat('k', id) AS binary) AS key", "cast('v' AS binary) AS value")
    write_log(rows, str(tmp_path / "out"))
    back = read_log(spark, str(tmp_path / "out")).orderBy("seq").collect()
    assert [bytes(r["key"]) for r in back] == [f"k{i}".encode() for i in range(100)]
    assert [r["op"] for r in back] == [i % 3 for i in range(100)]


def test_no_row_is_lost_whatever_the_seq(spark, tmp_path):
    """25,000 rows of one seq: every one comes back, with its vector."""
    rows = spark.range(25_000).selectExpr("1L AS seq", "cast(if(id % 5 = 0, 1, 0) AS byte) AS op", "cast(concat('k', id) AS binary) AS key", "cast(id AS string) AS v", "if(id % 5 = 0, array(cast(id AS float), cast(2 AS float)), null) AS vec").selectExpr("seq", "op", "key", "cast(v AS binary) AS value", "vec")
    path = str(tmp_path / "out")
    assert write_log(rows, path, file_bytes=20_000) > 8
    back = changes_of(read_log(spark, path), spark, path).collect()
    assert {bytes(r["key"]): (r["op"], bytes(r["value"]), r["vec"]) for r in back} == {f"k{i}".encode(): (int(i % 5 == 0), str(i).encode(), [float(i), 2.0] if i % 5 == 0 else None) for i in range(25_000)}
    assert len(back) == 25_000
    with pytest.raises(FileExistsError):
        write_log(rows, path)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def test_order_of_replay_is_order_of_seq(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id AS seq", "cast(0 AS byte) AS op", "cast(concat('k', id % 7) AS binary) AS key", "cast(cast(id AS string) AS binary) AS value").repartition(5)
    write_log(rows, str(tmp_path / "out"), file_bytes=5000)
    back = read_log(spark, str(tmp_path / "out")).orderBy("seq").collect()
    assert [int(bytes(r["value"])) for r in back] == list(range(3000))


def test_repair_cuts_only_what_is_torn(spark, tmp_path):
    good = encode(0, b"a", b"1") + encode(2, b"b", b"")
    (tmp_path / "wal_1.log").write_bytes(good)
    (tmp_path / "wal_2.log").write_bytes(good + bytes(range(1, 13)))
    (tmp_path / "wal_3.log").write_bytes(b"junk")
    assert repair_log(spark, str(tmp_path)) == {"wal_2.log": len(good), "wal_3.log": 0}
    assert [(tmp_path / f"wal_{k}.log").read_bytes() for k in (1, 2, 3)] == [good, good, b""]
    with (tmp_path / "wal_2.log").open("ab") as f:
        f.write(good)
    assert read_log(spark, str(tmp_path)).count() == 6 and repair_log(spark, str(tmp_path)) == {}


def test_strange_pointers(spark, tmp_path):
    pointers = [struct.pack(">qqi", 0, 4, 1), struct.pack(">qqi", -1, 0, 1), struct.pack(">qqi", 0, -4, 1), struct.pack(">qqi", 0, 0, -1), struct.pack(">qqi", 0, 1 << 40, 1), b"short"]
    (tmp_path / "wal_1.log").write_bytes(b"".join(encode(1, bytes([k]), b"", p) for k, p in enumerate(pointers)))
    (tmp_path / "vlog-000.data").write_bytes(struct.pack(">2f", 1.0, 2.0))
    got = {r["key"][0]: r["vec"] for r in vectors_of(read_log(spark, str(tmp_path)), spark, str(tmp_path)).collect()}
    assert got == {0: [2.0], 1: None, 2: None, 3: None, 4: None, 5: None}


entries = st.dictionaries(st.binary(max_size=6), st.tuples(st.integers(0, 2), st.binary(max_size=300), st.sampled_from([b"", bytes(20)])), max_size=60)


@given(entries)
@settings(max_examples=60, deadline=None)
def test_sorted_tables(rows):
    ordered = [(op, k, v, p) for k, (op, v, p) in sorted(rows.items())]
    out = io.BytesIO()
    assert tables.write(out, ordered) == len(rows)
    data = out.getvalue()
    if not rows:
        assert data == b""
        return
    table = tables.open_table(io.BytesIO(data), len(data))
    assert (table.low, table.high) == (ordered[0][1], ordered[-1][1])
    assert list(tables.entries(io.BytesIO(data), 0, table.filter_at)) == ordered
    assert all(tables.find(io.BytesIO(data), table, e[1]) == e for e in ordered)
    assert all(b - a <= tables.BLOCK for a, b in zip(table.offsets, table.offsets[1:]))
    assert tables.find(io.BytesIO(data), table, b"not there") is None
    again = tables.Bloom.unpack(table.bloom.pack())
    assert all(again.may_contain(k) for k in rows) and (again.bits, again.hashes) == (table.bloom.bits, table.bloom.hashes)
    for broken in (data[:-1], data[:-8] + bytes(8), b"x"):
        with pytest.raises(ValueError):
            tables.open_table(io.BytesIO(broken), len(broken))


def test_bloom_filter_by_its_definition():
    assert (tables.Bloom.sized(100_000).bits, tables.Bloom.sized(100_000).hashes) == (958_505, 7)
    rng = random.Random(1)
    for _ in range(50):
        key = rng.randbytes(rng.randrange(12))
        for k, at in enumerate(tables.places(key, 1009, 5)):
            h = k
            for b in key:
                h = (31 * h + (b - 256 if b > 127 else b)) % 2**32
            assert at == (h % 2**31) % 1009
    bloom = tables.Bloom.sized(2000)
    for i in range(2000):
        bloom.add(rng.randbytes(16))
    # The format's hashes of one key are in arithmetic progression, so the rate is far above the 1 % it is sized for.
    assert sum(bloom.may_contain(rng.randbytes(16)) for _ in range(5000)) < 1000


def test_tables_of_several_levels(spark, tmp_path):
    make = lambda rows: spark.createDataFrame([(op, bytearray(k), bytearray(v)) for op, k, v in rows], "op byte, key binary, value binary")
    for level, number, rows in ((1, 1, [(0, b"a", b"old"), (0, b"b", b"old"), (0, b"c", b"old")]), (0, 1, [(0, b"a", b"mid"), (2, b"b", b"")]), (0, 2, [(0, b"a", b"new"), (0, b"big", b"x" * 9000)])):
        part = tmp_path / f"{level}-{number}"
        write_tables(make(rows).coalesce(1), str(part), level)
        for p in part.glob("*.sst"):
            p.rename(tmp_path / f"L{level}-{number:06d}.sst" if not (tmp_path / f"L{level}-{number:06d}.sst").exists() else tmp_path / f"L{level}-{number + 5:06d}.sst")
    from ridgeline.plans.state import live

    got = {bytes(r["key"]): bytes(r["value"]) for r in live(read_tables(spark, str(tmp_path))).collect()}
    assert got == {b"a": b"new", b"c": b"old", b"big": b"x" * 9000}
    asked = lambda k: [bytes(r["value"]) for r in find_in_tables(spark, str(tmp_path), k).collect()]
    assert [asked(k) for k in ("a", "b", "c", "zz")] == [[b"new"], [], [b"old"], []]


def test_frames_of_expressions_equal_encoded_ones(spark):
    from pyspark.sql import functions as F

    from ridgeline.functions.frames import frame

    rows = [(0, b"k", b"v", None), (2, b"", b"", None), (1, b"\xff\x00", b"x" * 300, bytes(range(20)))]
    df = spark.createDataFrame([(a, bytearray(b), bytearray(c), None if d is None else bytearray(d)) for a, b, c, d in rows], "op byte, key binary, value binary, pointer binary")
    got = [bytes(r["f"]) for r in df.select(frame(F.col("op"), F.col("key"), F.col("value"), F.col("pointer")).alias("f")).collect()]
    assert got == [encode(a, b, c, d or b"") for a, b, c, d in rows]
