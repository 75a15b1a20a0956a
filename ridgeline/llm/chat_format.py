"""Chat formatting over reply trees.

Messages point to their parents. Iterative self-joins double the reach of every pointer, so that root, depth
and path score of every message are known after a logarithmic number of joins; the best leaves of each tree
are chosen, the same pointers list the messages on their paths, and each path is written as one conversation.

Template of a turn: `### role`, a line break, the text, `</turn>` and a line break. A backslash before a
character makes it literal; texts get one before each backslash and before control strings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import durable, table

TRAINED = "assistant"
#: Turns that are joined into one string before strings are joined: keeps a very long conversation off one task.
BLOCK = 64


# Template


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(\\|#(?=##)|<(?=/turn>))", r"\\$1")


def escaped_role(role: Column) -> Column:
    return F.regexp_replace(F.coalesce(role, F.lit("")), r"(\\|\n)", r"\\$1")


_TURN = re.compile(r"### ((?:[^\\\n]|\\.)*+)\n((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def parse(conversation: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(conversation):
        turn = _TURN.match(conversation, at)
        if not turn:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(turn[1]), unescape(turn[2])))
        at = turn.end()
    return out


# Trees


def reach(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """From (tree, node, parent, score): (tree, node, top, depth, total) and the pointers of every doubling.

    Level k has (tree, node, up): the message 2**k above. Messages on or below a cycle have no root; they are
    left out of the first result. A parent that does not exist counts as none.
    """
    known = nodes.select("tree", F.col("node").alias("up"))
    level = nodes.withColumnRenamed("parent", "up").join(known, ["tree", "up"], "left_semi").select("tree", "node", "up")
    first = nodes.join(level, ["tree", "node"], "left")
    state = durable(first.select("tree", "node", "up", F.coalesce("up", "node").alias("top"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total")))
    levels, total = [], state.count()
    done, open_ = state.where("up IS NULL"), state.where("up IS NOT NULL")
    # Only messages whose pointer is still open are joined again. After k doublings it spans 2**k messages, so
    # an acyclic tree is done before 2**k exceeds the total.
    while 1 << len(levels) <= max(total, 1) and not open_.isEmpty():
        levels.append(open_.select("tree", "node", "up"))
        above = done.union(open_).select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        s = open_.join(above, ["tree", "up"])
        state = durable(s.select("tree", "node", F.col("up2").alias("up"), F.col("top2").alias("top"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total")))
        done, open_ = done.union(state.where("up IS NULL")), state.where("up IS NOT NULL")
    return done.drop("up"), levels


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(tree, path, node, position) for the `top` best root-to-leaf paths of each root.

    nodes: tree, node (unique in its tree), parent, score. Branches rank by the mean score of their messages,
    then the longer, then the smaller leaf. path is the leaf's node.
    """
    placed, levels = reach(nodes)
    inner = nodes.select("tree", F.col("parent").alias("node")).where("node IS NOT NULL").distinct()
    leaves = placed.join(inner, ["tree", "node"], "left_anti").withColumn("mean", F.col("total") / (F.col("depth") + 1))
    order = Window.partitionBy("tree", "top").orderBy(F.desc("mean"), F.desc("depth"), "node")
    chosen = leaves.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    on_path = durable(chosen.select("tree", F.col("node").alias("path"), "node"))
    for level in levels:
        above = on_path.join(level, ["tree", "node"]).select("tree", "path", F.col("up").alias("node"))
        on_path = durable(on_path.union(above))
    return on_path.join(placed.select("tree", "node", F.col("depth").alias("position")), ["tree", "node"])


# Conversations


def _spans(turns: pd.Series) -> pd.Series:
    """Where the trained texts are, from (length of the turn, before its text, of its text, trained) in order."""
    out = []
    for rows in turns:
        at, spans = 0, []
        for r in rows:
            if r["trained"]:
                spans.append({"start": at + r["head"], "stop": at + r["head"] + r["body"]})
            at += r["size"]
        out.append(spans)
    return pd.Series(out)


def format_paths(paths: DataFrame, messages: DataFrame, trained: str = TRAINED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(tree, path, turns, conversation, loss): one row per path; loss lists the spans that count for training.

    keep: columns of messages that are the same for all messages of a tree and go along with it.
    """
    text, role = escaped(F.col("text")), escaped_role(F.col("role"))
    turns = paths.join(messages.select("tree", "node", *keep, role.alias("role"), text.alias("text"), F.coalesce(F.col("role") == trained, F.lit(False)).alias("trained")), ["tree", "node"])
    head = F.length("role") + 5
    turn = F.struct(
        "position", F.concat(F.lit("### "), "role", F.lit("\n"), "text", F.lit("</turn>\n")).alias("turn"),
        F.struct((head + F.length("text") + 8).alias("size"), head.alias("head"), F.length("text").alias("body"), "trained").alias("shape"),
    )
    key, block = ("tree", "path", *keep), F.floor(F.col("position") / BLOCK)
    blocks = turns.groupBy(*key, block.alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    blocks = blocks.select(*key, F.struct("block", F.array_join("turns.turn", "").alias("text"), F.col("turns.shape").alias("shapes")).alias("block"))
    whole = blocks.groupBy(*key).agg(F.sort_array(F.collect_list("block")).alias("blocks"))
    shapes = F.flatten("blocks.shapes")
    return whole.select(*key, F.size(shapes).cast("long").alias("turns"), F.array_join("blocks.text", "").alias("conversation"), F.pandas_udf(_spans, "array<struct<start:long,stop:long>>")(shapes).alias("loss"))


def from_turns(conversations: DataFrame) -> DataFrame:
    """(tree, node, parent, score, role, text) from (conv_id, turn, role, text): each row replies to the one before.

    node numbers a conversation's rows by turn (null first), then role and text, without a window over the
    whole conversation: rows are numbered within ranges of turns, ranges by their sizes.
    """
    span = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 63)))
    keyed = conversations.select(F.col("conv_id").alias("conv"), F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("tree"), span.alias("span"), "turn", "role", "text")
    keyed = keyed.withColumn("number", F.row_number().over(Window.partitionBy("tree", "span").orderBy("turn", "role", "text")))
    sizes = keyed.groupBy("tree", "span").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("span").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    placed = keyed.join(sizes.select("tree", "span", before.alias("start")), ["tree", "span"])  # dealt like the first window
    node = F.col("start") + F.col("number") - 1
    return placed.select("conv", "tree", node.alias("node"), F.when(node > 0, node - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turns, conversation, loss: every row of (conv_id, turn, role, text), each once.

    Null texts and roles are empty; a null conv_id is a conversation of its own; rows with the same turn are
    ordered by role and text, and repeated rows all stay. An empty table gives an empty result.
    """
    messages = durable(from_turns(conversations))
    done = format_paths(best_paths(messages.select("tree", "node", "parent", "score")), messages, keep=("conv",))
    return done.select(F.col("conv").alias("conv_id"), "turns", "conversation", "loss")


# Reading back


def read_back(formatted: DataFrame) -> DataFrame:
    """The contract's digests, from the formatted conversations and their spans alone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for key, text, loss in zip(df["conv_id"].astype(object), df["conversation"], df["loss"]):
                turns = parse(text)
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                under = "".join(unescape(text[x["start"] : x["stop"]]) for x in loss)
                rows.append((None if pd.isna(key) else key, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return formatted.select("conv_id", "conversation", "loss").mapInPandas(digests, schema)


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return read_back(format_conversations(rows.unionByName(probe)))


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(regexp_replace(regexp_replace(regexp_replace(text, '\\', '\\\\', 'g'), '</turn>', '\\</turn>', 'g'), '###', '\\###', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + length(role) + 13)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
