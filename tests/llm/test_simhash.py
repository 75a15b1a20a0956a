import random

import numpy as np
import pytest
import xxhash

from ridgeline.llm import simhash as op


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in text + " ":
        if c in "\x20\t\n\x0b\x0c\r":
            words, word = [*words, word] if word else words, ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """doc_id by row -> smallest doc_id reachable over links of at most 4 bits."""
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in fps}


TEXTS = ["", None, " \n", "One", "one two three", "One two three four", "ÄÖ É x y z", "a b c d e f", "a b c d e " * 5000, "x", "X", "one  TWO\tthree"]


def test_fingerprints_match_the_definition():
    rng = random.Random(1)
    for t in TEXTS[:8] + [" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 60))) for _ in range(40)]:
        assert op.fingerprint(t) % 2**64 == slow_fingerprint(t), t


def clustered(n, seed):
    rng, out = random.Random(seed), []
    for _ in range(n):
        base = rng.choice(out) if out and rng.random() < 0.7 else rng.getrandbits(64)
        out.append(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))))
    return out


@pytest.mark.parametrize(("code", "crowd"), [(op.SMALL, 4000), (op.LARGE, 4000), (op.SMALL, 3), (op.Code(4, 3), 20), (op.Code(5, 2), 4000)])
def test_every_link_is_found(spark, code, crowd):
    fps = sorted(set(clustered(300, 5)))
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = op.connected_components(op.links(df, code, crowd), "a", "b")
    got = {r["node"]: r["component"] for r in found.collect()}
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= code.distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = {x: find(x) for x in signed}
    assert {x: got.get(x, x) for x in signed} == want


def test_near_duplicates_of_documents(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices("abcdefghijklmnop", k=400)) for _ in range(8)]
    texts = TEXTS + base + [b + " extra" for b in base] + [b.upper() for b in base]
    rows = [(100 - k, t) for k, t in enumerate(texts)] + [(95, TEXTS[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component", "3 AS node")
    got = op.near_duplicates(docs).collect()
    fps = {i: slow_fingerprint(t) for i, t in rows}
    want = components(fps)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((i, f"{fps[i]:016x}", want[i]) for i, _ in rows)


def test_many_close_fingerprints_make_few_links(spark):
    rng = random.Random(8)
    fps = {sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(1500)}
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    edges = op.links(df)
    assert edges.count() < 60 * len(fps)
    assert op.connected_components(edges, "a", "b").agg({"component": "count"}).first()[0] == len(fps)


def test_empty_table_and_stage(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.near_duplicates(docs).count() == 0 and op.drop_near_duplicates(docs).columns == docs.columns
    docs = spark.createDataFrame([(2, "a b c d e", "k"), (1, "a b c d e", "k"), (None, "z", "k")], "doc_id long, text string, keep_key string")
    assert sorted(str(r["doc_id"]) for r in op.drop_near_duplicates(docs).collect()) == ["1", "None"]


def test_stage_keeps_one_of_repeated_rows(spark):
    t = "a b c d e f g h"
    rows = [(1, t, "x"), (1, t, "x"), (1, t, "y"), (1, t.upper(), "z"), (2, t, "x"), (5, "other words are in here now", "x"), (5, "still other words that are not there", "x"), (None, "and again something else entirely", "x"), (None, "and again something else entirely", "x")]
    kept = [tuple(r) for r in op.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()]
    assert sorted(str(r[0]) for r in kept) == ["1", "5", "5", "None"] and len({r[1].lower() for r in kept}) == 4


def test_a_crowded_anchor_in_small_memory():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 40, 500)
    home = np.arange(500) < 60
    import pandas as pd

    frame = pd.DataFrame({"group": np.ones(500, np.int64), "fp": fps, "home": home})
    frames = [frame.iloc[k : k + 50] for k in range(0, 500, 50)]
    got = pd.concat(list(op._links(iter(frames), 14, most=120)))
    want = {tuple(sorted((int(a), int(b)))) for a in fps[home] for b in fps if a != b and int(a ^ b).bit_count() <= 14}

    def classes(pairs):
        parent = {int(x): int(x) for x in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = find(int(a)), find(int(b))
            parent[max(a, b)] = min(a, b)
        return {x: find(x) for x in parent}

    found = set(zip(got["a"], got["b"]))
    assert found <= want | {(x, x) for x in fps.tolist()} and classes(found) == classes(want)


def test_hot_fingerprints_and_components(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'one two three four five' ELSE concat('w', id, ' x', id * 7, ' y', id * 13) END AS text")
    out = op.near_duplicates(docs)
    assert out.count() == 6000 and out.where("component_id = 0").count() >= 3000
