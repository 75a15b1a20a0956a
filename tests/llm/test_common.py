import random

import pytest

from ridgeline.llm.common import connected_components, fresh


def brute(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def graphs():
    rng = random.Random(4)
    yield "path", [(k, k + 1) for k in range(300)]
    order = list(range(200))
    rng.shuffle(order)
    yield "shuffled path", list(zip(order, order[1:]))
    yield "star", [(5000, k) for k in range(3000)]
    yield "two stars", [(0, k) for k in range(1, 1500)] + [(9999, k) for k in range(1400, 3000)]
    yield "random", [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    yield "repeats and negatives", [(-5, 3), (3, -5), (3, 9), (7, 7), (-(2**62), 2**62)]


@pytest.mark.parametrize(("name", "edges"), list(graphs()))
def test_components(spark, name, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = [tuple(r) for r in connected_components(df, "a", "b").collect()]
    want = {x: c for x, c in brute(edges).items() if any(x in e and e[0] != e[1] for e in edges)}
    assert len(got) == len(set(got)) and dict(got) == want


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "KEY int, _key int")
    assert fresh(df, "key", "key") == ["__key", "___key"]
