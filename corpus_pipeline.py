"""The corpus pipeline: from raw documents to packed token sequences.

Each stage gets all that its predecessor kept, as a table, and returns a DataFrame; all but the last return the
columns of documents. An empty table passes through every stage.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm import chunk_dedup, language_id, mixing, packing, simhash
from ridgeline.llm.common import shared_dir, table
from ridgeline.runtime import ship
from ridgeline.sources.files import Folder


def _stage(work):
    """A stage whose Python workers find the package."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return work(spark, docs, sf_dir)

    return run_stage


@_stage
def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in none of the labelled languages go: those without letters and those that no language
    explains. The rest stay as they are."""
    return language_id.drop_foreign(docs)


@_stage
def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest original stays, then the smallest doc_id; one row of each."""
    return chunk_dedup.drop_exact_duplicates(docs)


@_stage
def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays, as one row."""
    return simhash.drop_near_duplicates(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, from not at all to three times."""
    return mixing.mixed(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens and 256 documents at most."""
    return packing.packed(docs, capacity=packing.Capacity(documents=256))


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the language model nor fingerprints, mixing or packing; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. The tables between stages are in the session's shared folder; all but the one
    that the result is read from are removed again."""
    docs = table(spark, sf_dir, "documents")
    path, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        if before:
            Folder(spark, path).remove(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
