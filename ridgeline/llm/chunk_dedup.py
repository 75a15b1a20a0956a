"""Exact deduplication by content-defined chunk recipes.

A text is normalised, cut where its own content says so, and written as its recipe: the ordered
list of its chunks' identifiers. Distinct chunks travel once, to prove that an identifier stands for
one chunk only; after that the short recipes are compared and no text moves again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import SPACE, attach, durable, identity, keep_rows, named, table


@dataclass(frozen=True)
class Chunking:
    """After `least` characters a chunk ends before the next beginning of a clause: a mark and a letter or digit.

    Such places are some tens of characters apart, so that two texts that share a passage soon cut it alike. A
    text without them is cut every `most` characters: still exact, only fewer shared chunks.
    """

    least: int = 384
    most: int = 4096
    left: str = r"[.,;:!?|)»”。、！？，]"
    right: str = r"[\p{L}\p{N}]"

    def pattern(self) -> str:
        return rf"(?s).{{{self.least},{self.most}}}?(?:{self.left}(?={self.right})|\z)|.{{1,{self.most}}}"


def normalised(text: Column) -> Column:
    """text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def chunks(norm: Column, chunking: Chunking = Chunking()) -> Column:
    """The pieces of norm in order; joined, they are norm again."""
    return F.regexp_extract_all(norm, F.lit(chunking.pattern()), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def clashes(docs: DataFrame, text: str = "text", chunking: Chunking = Chunking(), hashed=identifier) -> DataFrame:
    """(id) of identifiers that stand for more than one chunk.

    Chunks are compared as a whole. Copies are folded before the shuffle, so a passage that a third of
    all rows share is one row per task; per identifier only a count is kept.
    """
    pieces = docs.select(F.explode(chunks(normalised(named([text])[0]), chunking)).alias("chunk"))
    distinct = pieces.select(hashed(F.col("chunk")).alias("id"), "chunk").distinct()
    return distinct.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunking: Chunking = Chunking(), hashed=identifier) -> DataFrame:
    """One row per document: doc_id, n_chars (code points of the original), text_sha256, recipe, identity of the row."""
    key, body = named([doc_id, text])
    told = docs.select(key.alias("doc_id"), F.coalesce(F.length(body), F.lit(0)).cast("long").alias("n_chars"), normalised(body).alias("norm"), identity(key, body).alias("identity"))
    return told.select(
        "doc_id", "n_chars", F.sha2(F.encode("norm", "utf-8"), 256).alias("text_sha256"),
        F.transform(chunks(F.col("norm"), chunking), lambda c: hashed(c)).alias("recipe"), "identity",
    )


def _groups(docs: DataFrame, doc_id: str, text: str, chunking: Chunking, hashed=identifier) -> tuple[DataFrame, DataFrame]:
    """The documents' recipes, and one row per group of equal recipes: text_sha256, keep_id, keep_identity, group_size.

    A group is named by the digest that its texts share.
    """
    clash = durable(clashes(docs, text, chunking, hashed))
    base = durable(recipes(docs, doc_id, text, chunking, hashed))
    if clash.isEmpty():
        exact = base.withColumn("proof", F.lit(""))
    else:
        # An identifier that two chunks share proves nothing: those documents' digests tell them apart as well.
        broken = base.select("text_sha256", F.explode("recipe").alias("id")).join(clash, "id").select(F.col("text_sha256").alias("proof")).distinct()
        exact = base.join(broken, F.col("text_sha256") == F.col("proof"), "left").withColumn("proof", F.coalesce("proof", F.lit("")))
    best = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("identity").alias("d"))
    groups = exact.groupBy(F.xxhash64("recipe", "proof").alias("short"), "recipe", "proof").agg(F.min(best).alias("best"), F.count("*").alias("group_size"), F.first("text_sha256").alias("text_sha256"))
    return base.drop("recipe"), durable(groups.select("text_sha256", F.col("best.c").alias("keep_id"), F.col("best.d").alias("keep_identity"), "group_size"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunking: Chunking = Chunking(), hashed=identifier) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal when equal after deleting ASCII white space. The row with the most code points
    stays, then the smallest doc_id. Null texts count as empty; empty texts are equal to each other and
    have the empty recipe. A null doc_id sorts after all others. Rows that repeat a doc_id with an
    equal text share that document's answer. An empty table gives an empty result.
    """
    base, groups = _groups(docs, doc_id, text, chunking, hashed)
    out = attach(base.select("doc_id", "text_sha256"), groups, "text_sha256", "group_size")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunking: Chunking = Chunking()) -> DataFrame:
    """Exactly one row of each group of equal texts, with its columns unchanged.

    The rules are those of exact_duplicates; of rows that repeat both doc_id and text, one stays (the least hash
    of all columns). Columns of docs may have any names.
    """
    _, groups = _groups(docs, doc_id, text, chunking)
    return keep_rows(docs, groups.select(F.col("keep_identity").alias("identity")), doc_id, text)


def query(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
