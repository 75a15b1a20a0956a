"""What several operators share: identities of rows, answers for hot keys, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.durable import durable, shared_dir

#: White space of every word definition here: the ASCII characters 9 to 13 and 32.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["attach", "connected_components", "durable", "fresh", "identity", "keep_rows", "named", "row_hash", "shared_dir", "table", "word_count"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that df does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def named(names: list[str]) -> list[Column]:
    """Columns by their exact names, whatever characters these have."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def identity(doc_id: Column, text: Column) -> Column:
    """A digest of doc_id and text, nulls included. Rows of one identity differ in other columns at most."""
    key = F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(key).cast("string"), key, F.coalesce(F.concat(F.lit("="), text.cast("string")), F.lit(""))), 256))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that have one (maps have none)."""
    return F.xxhash64(*[c for c, f in zip(named(df.columns), df.schema) if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))])


def keep_rows(docs: DataFrame, chosen: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of docs whose identity is in chosen (identity, distinct), one row of each; columns unchanged.

    Of rows with one identity the least row_hash stays. Ranks are limited before the shuffle, so a row that is
    repeated a billion times sends one row per task, and texts move once.
    """
    mark, place = fresh(docs, "row_identity", "row_place")
    marked = docs.withColumn(mark, identity(*named([doc_id, text])))
    ranked = marked.withColumn(place, F.row_number().over(Window.partitionBy(mark).orderBy(row_hash(docs)))).where(F.col(place) == 1)
    return ranked.join(chosen.select(F.col("identity").alias(mark)), mark, "left_semi").select(*named(docs.columns))


def attach(rows: DataFrame, answers: DataFrame, key: str, weight: str) -> DataFrame:
    """rows with the columns of answers, which has one row per key; weight says how many of rows have the key.

    A key of more than a 2,000th part of all rows would meet them in one task. There are fewer than 2,000 such
    keys, so their answers are broadcast; the others are joined by key. Both tables must be durable.
    """
    total = answers.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > max(1000, total // 2000)
    often = answers.where(hot)
    if often.isEmpty():
        return rows.join(answers, key)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(answers.where(~hot), key)
    return rows.join(F.broadcast(often), key).unionByName(rest)


def _star(pairs: DataFrame, large: bool, links: int) -> DataFrame:
    """One round of stars over `links` rows (u, v): every node's neighbours move to its smallest neighbour.

    A node of many links would meet all of them in one task of the join. Such nodes are few (their links sum up
    to all links), so they are broadcast: at most 5,000, as the limit grows with the links.
    """
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    low = low.select("u", F.least("u", "m").alias("m"), "n")
    many = F.col("n") > max(16, 2 * links // 5000)
    hub = F.broadcast(low.where(many).select(F.col("u").alias("hub"), F.col("m").alias("hub_m")))
    rows = (both.where("v > u") if large else both).join(hub, F.col("u") == F.col("hub"), "left")
    rest = rows.where("hub IS NULL").select("u", "v").join(low.where(~many).select("u", "m"), "u").select("v", "m")
    moved = rows.where("hub IS NOT NULL").select("v", F.col("hub_m").alias("m")).union(rest)
    moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(low.select("u", "m"))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node on an edge; component is its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): only minima and equi-joins,
    so no neighbour list is gathered, and the depth is logarithmic. Each round is durable.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    pairs = durable(edges.select(u.alias("u"), v.alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        seen = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if seen == mark or not seen[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark = seen
        pairs = durable(_star(_star(pairs, True, seen[0]), False, seen[0]))
