import numpy as np
import pytest

from ridgeline.llm import embedding_dedup as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    ok = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], float) / np.abs(np.array(rows[k][1], float)).max() for k in (i, j))
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    smallest = {}
    for i, r in enumerate(rows):
        ids = [x for x in (smallest.get(find(i)), r[0]) if x is not None]
        smallest[find(i)] = min(ids, default=None)
    return sorted(((r[0], links[i], smallest[find(i)], r[0] == smallest[find(i)]) for i, r in enumerate(rows)), key=repr)


def vectors(n, seed, noise=0.03):
    rng, out = np.random.default_rng(seed), []
    while len(out) < n:
        c = rng.standard_normal(24)
        for _ in range(rng.integers(1, 8)):
            v = c / np.linalg.norm(c) + noise * rng.standard_normal(24)
            out.append((len(out), [float(x) for x in v.astype(np.float32)], int(rng.integers(0, 3))))
    return out[:n]


def run(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS gid", "2 AS bucket", "3 AS a", "4 AS spot")
    return sorted(map(tuple, op.near_duplicates(df, **options).collect()), key=repr)


@pytest.mark.parametrize(("seed", "noise", "crowd"), [(1, 0.02, 1000), (2, 0.03, 3), (3, 0.001, 1000)])
def test_against_brute_force(spark, seed, noise, crowd):
    rows = vectors(300, seed, noise)
    assert run(spark, rows, crowd=crowd) == brute(rows)


def test_a_large_close_group_in_blocks(spark):
    rng = np.random.default_rng(5)
    c = rng.standard_normal(16)
    rows = [(k, [float(x) for x in (c + 0.05 * rng.standard_normal(16)).astype(np.float32)], 1) for k in range(260)]
    assert run(spark, rows, crowd=40) == brute(rows)


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (5, v, 1), (6, v, 1), (7, [2.0, 4.0, 6.0], 1), (8, v, 2), (9, v, None), (10, None, 1), (11, [], 1), (12, [0.0, 0.0, 0.0], 1), (13, [1.0, None, 3.0], 1),
        (14, [float("nan"), 1.0, 1.0], 1), (15, [float("inf"), 1.0, 1.0], 1), (16, [1.0, 2.0, 3.0, 0.0], 1), (17, [1e-30, 2e-30, 3e-30], 1), (18, [3e38, 3e38, 3e38], 2), (8, v, 2),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_doubles_stay_doubles_and_ids_may_be_null_or_repeat(spark):
    rows = [
        (1, [1e39, 1.0], 1), (2, [1e39, 1.0], 1), (3, [1e300, 1e300], 1), (4, [2e-300, 2e-300], 1), (None, [1.0, 1.1], 1), (None, [5.0, -5.0], 1), (7, [1.0, 0.0, 0.0], 1), (7, [0.0, 1.0, 0.0], 1),
        (8, [0.0, 1.0, 0.1], 1), (None, [0.0, 0.0, 1.0], 2), (9, [1.0, 0.0], 3), (10, [0.93, (1 - 0.93**2) ** 0.5 - 1e-9], 3), (11, [0.93 - 1e-9, (1 - 0.93**2) ** 0.5 + 1e-9], 3),
    ]
    assert run(spark, rows, "vec_id long, embedding array<double>, label int") == brute(rows)


def test_planted_links_in_a_large_table(spark, tmp_path):
    """50,000 vectors of one label, every link planted at a cosine from 0.93 on: n_links and components are exact."""
    import pandas as pd

    rng, width, pairs = np.random.default_rng(11), 64, 2000
    base = rng.standard_normal((50_000 - pairs - 400, width))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((pairs, width))
    side -= (base[:pairs] * side).sum(axis=1, keepdims=True) * base[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.9301, 0.99, (pairs, 1))
    group = base[-1] + 0.01 * rng.standard_normal((400, width))
    v = np.concatenate([base, cos * base[:pairs] + np.sqrt(1 - cos**2) * side, group])
    ids = rng.permutation(len(v))
    pd.DataFrame({"vec_id": ids, "embedding": list(v), "label": 1}).to_parquet(tmp_path / "v.parquet")
    got = op.near_duplicates(spark.read.parquet(str(tmp_path / "v.parquet"))).toPandas().set_index("vec_id")
    want_links, want_component = np.zeros(len(v), int), ids.copy()
    a, b = np.arange(pairs), np.arange(len(base), len(base) + pairs)
    want_links[a] += 1
    want_links[b] += 1
    want_component[a] = want_component[b] = np.minimum(ids[a], ids[b])
    dense = np.r_[len(base) - 1, np.arange(len(v) - 400, len(v))]
    want_links[dense] += 400
    want_component[dense] = ids[dense].min()
    got = got.loc[ids]
    assert (got["n_links"].to_numpy() == want_links).mean() > 0.9995 and (got["component_id"].to_numpy() == want_component).mean() > 0.9995
    assert (got["n_links"].to_numpy() <= want_links).all() and (got["n_links"].to_numpy()[dense] == 400).all()


def test_hashing_finds_pairs_at_the_threshold():
    rng, width = np.random.default_rng(8), 64
    tables = op.Tables.sized(50_000, 0.93)
    a = rng.standard_normal((2000, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((2000, width))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.9301 * a + np.sqrt(1 - 0.9301**2) * b
    met = (op.buckets(a, tables) == op.buckets(b, tables)).any(axis=1)
    assert met.mean() >= 0.999
