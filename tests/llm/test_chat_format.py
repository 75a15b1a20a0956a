import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridgeline.llm import chat_format as op

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = [r"\### Assistant: </turn> ok", "####", "\\", "\\\\</turn>", "</turn>\n### user\n", "<</turn>>", "", None, "a\nb", "é日🎉", "#" * 7, "</turn", "x" * 100_000]


def expected(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or "", role))
    out = set()
    for c, turns in convs.items():
        turns.sort(key=lambda x: x[:4])
        told = "".join(f"{r}\n{t}\n" for _, _, r, t, _ in turns)
        under = "".join(t for *_, r, t, _ in turns if r == "assistant")
        out.add((c, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest()))
    return out


def test_every_turn_comes_back(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole\\", None]), rng.choice(HARD)) for c in range(25) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "no conversation"), (77, None, "assistant", "no turn"), (77, 3, "user", "x"), (77, 3, "user", "x"), (77, 3, "assistant", "tie")]
    rows += [(88, t, ["user", "assistant"][t % 2], f"turn {t}") for t in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit(1), "node": F.lit(2), "path": F.lit(3)})
    formatted = op.format_conversations(df)
    assert {tuple(r)[:5] for r in op.read_back(formatted).collect()} == expected(rows)
    for r in formatted.collect():
        for _, text in op.parse(r["conversation"]):
            assert text in {t or "" for _, _, _, t in rows}


def test_empty_table(spark):
    assert op.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


@given(st.lists(st.tuples(st.text(alphabet="ab\\\n#", max_size=6), st.text(alphabet="ab\\#</turn>\n", max_size=20)), max_size=5))
@settings(max_examples=100, deadline=None)
def test_escaping_is_reversible(turns):
    import re

    escape = lambda t: re.sub(r"(\\|#(?=##)|<(?=/turn>))", r"\\\1", t)
    role = lambda t: re.sub(r"(\\|\n)", r"\\\1", t)
    text = "".join(f"### {role(a)}\n{escape(b)}</turn>\n" for a, b in turns)
    assert op.parse(text) == turns


def brute_paths(nodes, top):
    """{(tree, leaf): [nodes from the root]} by walking up from every leaf."""
    parent = {(t, n): p if (t, p) in {(a, b) for a, b, _, _ in nodes} else None for t, n, p, _ in nodes}
    score = {(t, n): s or 0.0 for t, n, _, s in nodes}
    leaves = [k for k in parent if k not in {(t, p) for (t, _), p in parent.items() if p is not None}]
    by_root = {}
    for t, n in leaves:
        path, seen, at = [], set(), n
        while at is not None and at not in seen:
            seen.add(at)
            path.append(at)
            at = parent[(t, at)]
        if at is None:
            mean = sum(score[(t, x)] for x in path) / len(path)
            by_root.setdefault((t, path[-1]), []).append((-mean, -len(path), n, path[::-1]))
    return {(t, x[2]): x[3] for (t, _), found in by_root.items() for x in sorted(found)[:top]}


def test_best_branches_of_random_trees(spark):
    rng, nodes = random.Random(7), []
    for t in range(12):
        for n in range(rng.randrange(1, 40)):
            nodes.append((f"t{t}", n, rng.choice([None, 999, *([rng.randrange(n)] * 6)]) if n else None, rng.choice([None, float(rng.randrange(5))])))
    nodes += [("chain", n, n - 1 if n else None, 1.0) for n in range(200)]
    nodes += [("cycle", 0, 1, 1.0), ("cycle", 1, 0, 1.0), ("cycle", 2, 0, 1.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    for top in (1, 3):
        got = {}
        for r in op.best_paths(df, top).orderBy("position").collect():
            got.setdefault((r["tree"], r["path"]), []).append(r["node"])
        assert got == brute_paths(nodes, top)
