"""Best-fit packing under several capacities at once.

Documents become token pieces; pieces are dealt at random into groups and every group is packed by vector
best-fit, largest pieces first. A sequence has three capacities (tokens, documents, attention cost: the
sum of squared piece lengths). Among the open sequences in which a piece fits under every capacity, the one
with the least weighted residual norm, or the largest weighted dot product, gets it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import durable, table


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds, and the weights of the three residual capacities (as shares) in the choice of one.

    By these weights documents and attention cost decide between sequences that a piece fills almost alike: of two
    with the same room, the one with more pieces or the higher cost gets it. documents = 2048 and attention = 2048**2
    follow from 2,048 tokens, so these limits refuse nothing by themselves; lower ones do.
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048**2
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)
    rule: str = "norm"  # or "dot"


# Tokens


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's file is, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of byte_bpe_50k.json as its library gives them: the string of a special token becomes that token.

    The same vocabulary as ranks gives the same ids several times faster where the two libraries' Unicode
    tables cannot differ (Latin text and general punctuation) and no special token occurs; other texts go through
    the JSON file itself.
    """

    def __init__(self, name: str = "byte_bpe_50k"):
        import base64
        import re

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(vocabulary_path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._full = Tokenizer.from_file(vocabulary_path(f"{name}.json"))
        self._special = [t.content for t in self._full.get_added_tokens_decoder().values()]
        self._plain = re.compile("[\\x00-ɏ‐-›€]*").fullmatch

    def ids(self, text: str) -> list[int]:
        if self._plain(text) and not any(t in text for t in self._special):
            return self._fast.encode_ordinary(text)
        return self._full.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


def cuts(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than most."""
    first = length % most or most
    if length <= most:
        return [(0, length)]
    return [(0, first), *((at, most) for at in range(first, length, most))]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 2048, vocabulary: str = "byte_bpe_50k", end: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, spread and, with with_ids, ids.

    A document's ids are its text's, then `end`; a null text is empty. spread differs between repeated rows.
    """
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, spread long" + ", ids array<int>" * with_ids

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, row = encoder(vocabulary).ids, 0
        for df in frames:
            out = []
            for key, value in zip(df.iloc[:, 0].astype(object), df.iloc[:, 1]):
                ids = np.array([*(encode(value) if value else ()), end], "<u4")
                row += 1
                for k, (start, length) in enumerate(cuts(len(ids), most)):
                    own = ids[start : start + length]
                    out.append((None if pd.isna(key) else key, k, start, length, zlib.crc32(own.tobytes()), row, *([own.astype(np.int32)] if with_ids else ())))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInPandas(split, schema)


# Packing


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; lengths in falling order give best-fit decreasing.

    Among the open sequences with room for the piece under every capacity, the one with the least weighted norm
    of what remains after it (rule norm), or the largest weighted product of what remains before it with what
    the piece needs (rule dot), gets it; of equals the oldest. Residuals are whole numbers, so nothing is rounded.
    """
    most = np.array([capacity.tokens, capacity.documents, int(capacity.attention)], np.int64)
    weights = np.array(capacity.weights)
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    room = np.empty((3, len(lengths) + 1), np.int64)  # residual capacities of the open sequences, oldest first
    name = np.empty(len(lengths) + 1, np.int64)
    open_, made, least = 0, 0, int(lengths.min()) if len(lengths) else 0
    for i, n in enumerate(lengths.tolist()):
        need = np.array([n, 1, n * n], np.int64)
        if (need > most).any():
            raise ValueError(f"a piece of {n} tokens exceeds a sequence's capacity")
        at = -1
        r = room[:, :open_]
        fits = np.flatnonzero((r >= need[:, None]).all(axis=0))
        if len(fits):
            if capacity.rule == "norm":
                part = (r[:, fits] - need[:, None]) / most[:, None]
                cost = weights[0] * (part[0] * part[0]) + weights[1] * (part[1] * part[1]) + weights[2] * (part[2] * part[2])
            else:
                part, share = r[:, fits] / most[:, None], need / most
                cost = -(weights[0] * (part[0] * share[0]) + weights[1] * (part[1] * share[1]) + weights[2] * (part[2] * share[2]))
            at = int(fits[cost.argmin()])
        if at < 0:
            at, open_ = open_, open_ + 1
            room[:, at], name[at] = most, made
            made += 1
        bins[i] = name[at]
        offsets[i] = most[0] - room[0, at]
        room[:, at] -= need
        if room[0, at] < least or room[1, at] < 1 or room[2, at] < least * least:  # nothing fits any more
            open_ -= 1
            room[:, at:open_] = room[:, at + 1 : open_ + 1]
            name[at:open_] = name[at + 1 : open_ + 1]
    return bins, offsets


def _pack(frames: Iterator[pd.DataFrame], capacity: Capacity) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []

    def done() -> Iterator[pd.DataFrame]:
        df = pd.concat(held) if len(held) > 1 else held[0]
        bins, offsets = best_fit(df["length"].to_numpy(), capacity)
        yield df.assign(sequence_id=(df["group"].to_numpy() << 24) + bins, offset=offsets).drop(columns="group")

    for df in frames:
        ends = np.flatnonzero(np.diff(df["group"].to_numpy())) + 1
        for part in np.split(np.arange(len(df)), ends):
            rows = df.iloc[part]
            if held and held[-1]["group"].iloc[-1] != rows["group"].iloc[0]:
                yield from done()
                held = []
            held.append(rows)
    if held:
        yield from done()


def pack(items: DataFrame, capacity: Capacity = Capacity(), group_rows: int = 4096) -> DataFrame:
    """items (of pieces()) with sequence_id and offset.

    Groups have about group_rows pieces each, dealt by a hash, so each is a fair sample of the lengths and at
    most its last sequences are not full. items must be durable: it is read twice.
    """
    groups = max(1, -(-items.count() // group_rows))
    dealt = items.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "spread", "ids_crc32"), F.lit(groups)).cast("long"))
    dealt = dealt.repartition("group").sortWithinPartitions("group", F.desc("length"), "doc_id", "piece", "spread")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return dealt.mapInPandas(lambda frames: _pack(frames, capacity), f"{schema}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths): the packed sequences; placed must have ids. One is at most capacity.tokens long."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p.ids", lambda x: F.size(x)).alias("lengths"))


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: Capacity = Capacity(), with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of docs.

    Null and empty texts are one piece of one id. Repeated rows are packed as often as they come. Other
    columns of docs are not read. An empty table gives an empty result.
    """
    items = durable(pieces(docs, doc_id, text, capacity.tokens, with_ids=with_ids))
    return pack(items, capacity).drop("spread")


def query(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
