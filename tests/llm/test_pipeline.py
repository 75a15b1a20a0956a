import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from ridgeline.llm import chunk_dedup, simhash

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The table after each stage."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    extra = spark.createDataFrame([(900001, None, "en", "src1", 0), (900002, "12 34", None, None, 5), (900003, "", "de", "src2", 0)], docs.schema)
    docs = docs.unionByName(extra)
    out.append(docs)
    for name, stage in pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_stages_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_language_stage_rejects_only_texts_without_letters(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[0].collect()}
    kept = {r["doc_id"] for r in stages[1].collect()}
    assert kept == {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}


def test_exact_stage(stages):
    best = {}
    for r in stages[1].collect():
        norm = re.sub(r"[\x20\x09-\x0D]+", "", r["text"])
        best[norm] = min(best.get(norm, (0, 0)), (-len(r["text"]), r["doc_id"])) if norm in best else (-len(r["text"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(i for _, i in best.values())


def test_near_stage(spark, stages):
    fps = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in stages[2].collect()}
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in fps:
        for j in fps:
            if i < j and ((fps[i] ^ fps[j]) % 2**64).bit_count() <= simhash.DISTANCE:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert sorted(r["doc_id"] for r in stages[3].collect()) == sorted({find(i) for i in fps})


def test_mixing_and_packing(stages):
    before = {r["doc_id"] for r in stages[3].collect()}
    mixed = stages[4].groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in mixed} <= before and all(1 <= r["count"] <= 3 for r in mixed)
    n = stages[4].count()
    packed = stages[5]
    assert packed.where("piece = 0").count() == n
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 2048 for r in per)


def test_run_and_empty_input(spark, tmp_path):
    assert pipeline.run(spark, DATA).count() > 0
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_decisions_agree_with_the_operator(spark, stages):
    kept = chunk_dedup.exact_duplicates(stages[1]).where("kept").count()
    assert kept == stages[2].count()


def test_odd_extra_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40).withColumns({"a.b": F.lit(1), "keep`key": F.lit(None).cast("string"), "Copies": F.lit(7), "h": F.lit(2.5), "norm": F.array(F.lit(1))})
    docs = docs.withColumns({"group": F.lit(1), "size": F.lit("mine"), "target": F.lit(None).cast("int"), "score": F.lit(3), "lang_pred": F.lit("x"), "row_identity": F.lit(0)})
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() > 0
    assert pipeline.STAGES[-1][1](spark, docs, DATA).count() >= 40


def test_without_labels_only_texts_without_letters_go(spark):
    docs = spark.createDataFrame([(1, "a text", None), (2, None, None), (3, "12", None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in pipeline.identify_languages(spark, docs, DATA).collect()] == [1]


def test_repeated_rows_and_ids_leave_one_row(spark):
    t = "some words that are long enough to be a text of its own"
    rows = [(1, t, "en", "s", 5)] * 3 + [(1, t.replace(" ", "  "), "en", "s", 6), (None, "another text entirely, by nobody", "en", "s", 1)] + [(None, "another text entirely, by nobody", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES[:3]:
        docs = stage(spark, docs, DATA)
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "None"]
