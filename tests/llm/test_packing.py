import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ridgeline.llm import packing as op

ROWS = [(1, None), (2, ""), (3, "Hello world"), (4, "word " * 5000), (5, "<|endoftext|> x"), (9, "a <|endoftext|> b"), (10, "日本<|endoftext|>"), (6, "日本語 text ٣ é́ 🎉   　 ok"), (7, "a" * 30_000), (3, "Hello world"), (8, "I'll don't 'tis 12½ \t\r\n  x ")]


def reference_ids(text):
    t = Tokenizer.from_file(op.vocabulary_path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_and_places(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS group")
    got = op.packed(docs).collect()
    expected = []
    for i, t in ROWS:
        ids = np.array(reference_ids(t), "<u4")
        first = len(ids) % 2048 or 2048 if len(ids) > 2048 else len(ids)
        bounds = [0, *range(first, len(ids), 2048), len(ids)]
        expected += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(expected)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(x[3] for x in expected)
    assert len(places) <= -(-total // 2048) + 1


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    rows = op.sequences(op.packed(docs, with_ids=True)).collect()
    assert sorted(x for r in rows for x in r["ids"]) == sorted(x for _, t in ROWS for x in reference_ids(t))
    assert all(sum(r["lengths"]) == len(r["ids"]) <= 2048 for r in rows)


@given(st.lists(st.integers(1, 100), max_size=60), st.integers(1, 8), st.sampled_from(["norm", "dot"]), st.floats(0.2, 1.0))
@settings(max_examples=80, deadline=None)
def test_every_capacity_holds(lengths, documents, rule, share):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    capacity = op.Capacity(100, documents, max(100.0**2 * share, float(lengths.max(initial=1)) ** 2), (1.0, 0.3, 0.5), rule)
    bins, offsets = op.best_fit(lengths, capacity)
    for b in set(bins.tolist()):
        mine = lengths[bins == b]
        assert mine.sum() <= 100 and len(mine) <= documents and (mine.astype(float) ** 2).sum() <= capacity.attention * (1 + 1e-9)
        assert sorted(offsets[bins == b].tolist()) == sorted((np.cumsum(mine) - mine).tolist())


def slow_best_fit(lengths, c):
    """Every sequence that was ever opened is asked."""
    most = (c.tokens, c.documents, c.attention)
    rooms, bins, offsets = [], [], []
    for n in lengths:
        need, best = (n, 1, n * n), None
        for k, room in enumerate(rooms):
            if all(a >= b for a, b in zip(room, need)):
                if c.rule == "norm":
                    x = [((a - b) / m) * ((a - b) / m) for a, b, m in zip(room, need, most)]
                else:
                    x = [-((a / m) * (b / m)) for a, b, m in zip(room, need, most)]
                cost = c.weights[0] * x[0] + c.weights[1] * x[1] + c.weights[2] * x[2]
                if best is None or cost < best[0]:
                    best = (cost, k)
        if best is None:
            rooms.append(list(most))
            best = (0, len(rooms) - 1)
        room = rooms[best[1]]
        bins.append(best[1])
        offsets.append(most[0] - room[0])
        rooms[best[1]] = [a - b for a, b in zip(room, need)]
    return bins, offsets


@given(st.lists(st.integers(1, 100), max_size=80), st.integers(1, 8), st.sampled_from(["norm", "dot"]), st.floats(0.2, 1.0), st.sampled_from([(1.0, 1e-6, 1e-6), (1.0, 0.3, 0.5), (0.2, 1.0, 0.0)]), st.booleans())
@settings(max_examples=150, deadline=None)
def test_bins_equal_those_of_a_slow_best_fit(lengths, documents, rule, share, weights, falling):
    lengths = sorted(lengths, reverse=True) if falling else lengths
    c = op.Capacity(100, documents, max(int(100**2 * share), max(lengths, default=1) ** 2), weights, rule)
    bins, offsets = op.best_fit(np.array(lengths, np.int64), c)
    assert (bins.tolist(), offsets.tolist()) == slow_best_fit(lengths, c)


def test_documents_and_attention_have_their_say():
    assert op.best_fit(np.array([70, 25, 5]), op.Capacity(100, 2, 100**2))[0].tolist() == [0, 0, 1], "two documents at most"
    assert op.best_fit(np.array([70, 25, 5]), op.Capacity(100, 9, 5000))[0].tolist() == [0, 1, 0], "attention cost at most 5,000"
    # 20 tokens are left in both: sequence 0 holds 80, sequence 1 holds 50 + 30.
    last = lambda w: op.best_fit(np.array([80, 50, 30, 5]), op.Capacity(100, 9, 100**2, w))[0].tolist()
    assert [last(w) for w in ((1.0, 0.0, 0.0), (1.0, 1.0, 0.0), (1.0, 0.0, 1.0))] == [[0, 1, 1, 0], [0, 1, 1, 1], [0, 1, 1, 0]]


def test_the_fullest_sequence_that_fits_is_chosen():
    bins, _ = op.best_fit(np.array([60, 50, 30, 40]), op.Capacity(100, 10, 1e9))
    assert bins.tolist() == [0, 1, 0, 1]


def test_too_large_a_piece_and_empty_table(spark):
    with pytest.raises(ValueError, match="exceeds"):
        op.best_fit(np.array([10]), op.Capacity(100, 10, 50.0))
    assert op.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_ids(spark):
    assert [r["doc_id"] for r in op.packed(spark.createDataFrame([(None, "x")], "doc_id long, text string")).collect()] == [None]
