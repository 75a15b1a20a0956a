import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ridgeline.llm import chunk_dedup as op

LONG = "word and text, " * 20_000


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((i, t or ""))
    out = []
    for norm, g in groups.items():
        keep = min(g, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0]
        out += [(i, keep, len(g), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in g]
    return sorted(out, key=repr)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"recipe": F.lit(1), "keep_id": F.lit("x"), "chunk": F.lit(2), "id": F.lit(3)})
    return sorted(map(tuple, op.exact_duplicates(docs, **options).collect()), key=repr)


ROWS = [(1, "a b"), (2, "a  b "), (3, "ab"), (4, None), (5, ""), (6, " \t\n\v\f\r"), (7, "A b"), (8, LONG), (9, LONG.replace(" ", "\n")), (10, LONG + "x"), (3, "ab"), (11, "a b"), (12, "日本" * 9000), (13, "日 本" * 9000), (14, "é"), (15, "é")]


def test_against_brute_force(spark):
    assert run(spark, ROWS) == brute(ROWS)


@pytest.mark.parametrize("hashed", [lambda c: F.lit(1).cast("long"), lambda c: F.length(c).cast("long")])
def test_colliding_identifiers_do_not_merge_texts(spark, hashed):
    assert run(spark, ROWS, hashed=hashed) == brute(ROWS)


def test_null_id_and_empty_table(spark):
    assert run(spark, [(None, "x"), (1, "x"), (None, "y")]) == brute([(None, "x"), (1, "x"), (None, "y")])
    assert run(spark, []) == []


def test_pieces_make_the_text_again(spark):
    texts = [LONG, "x" * 50_000, "aé日" * 3000, "a" * 512, "", "ha" * 4096]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", op.chunks(op.normalised(F.col("t"))).alias("c"))
    for r in df.collect():
        assert "".join(r["c"]) == re.sub(r"[\x20\x09-\x0D]+", "", r["t"])
        assert all(len(c) <= op.Chunking().most for c in r["c"])


def test_chunks_follow_the_content(spark):
    rng = random.Random(2)
    base = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + rng.choice([",", "", "", "."]) for _ in range(20_000))
    texts = [base, "inserted " + base]
    a, b = (set(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(op.chunks(op.normalised(F.col("t")))).collect())
    assert len(a & b) > 0.5 * min(len(a), len(b))


def test_stage_keeps_columns_and_one_of_each(spark):
    docs = spark.createDataFrame([(1, "a", "k"), (2, "a ", "k"), (3, "b", None)], "doc_id long, text string, keep_key string")
    kept = op.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def test_no_python_on_the_main_path(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for df in (op.exact_duplicates(docs), op.clashes(docs), op.recipes(docs)):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_stage_keeps_one_of_repeated_rows(spark):
    rows = [(1, "same text here ok", "k"), (1, "same text here ok", "k"), (1, "same text here ok", "other"), (7, "B  B", None), (7, "other text", None), (2, "BB", None), (None, "x", None), (None, "x", None), (None, "y", None), (3, None, None), (4, "", None)]
    kept = sorted(map(tuple, op.drop_exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string, keep_key string").withColumnRenamed("keep_key", "row_identity")).collect()), key=repr)
    assert [r[:2] for r in kept] == sorted([(1, "same text here ok"), (7, "B  B"), (7, "other text"), (None, "x"), (None, "y"), (3, None)], key=repr)


def test_a_hot_group_and_odd_column_names(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc.id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.concat(F.lit("t"), "id")).alias("te xt"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    out = op.exact_duplicates(docs, "doc.id", "te xt")
    assert out.where("keep_id = 0").count() == 1000 == out.where("keep_id = 0").first()["group_size"] and out.count() == 3000
    assert op.drop_exact_duplicates(docs, "doc.id", "te xt").count() == 2001
