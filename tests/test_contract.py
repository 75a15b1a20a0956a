import importlib.util

import __spark_entry__ as contract


def test_entry(spark):
    assert contract.entry(spark).count() == 12


def test_workers_find_the_package_from_any_folder(tmp_path):
    """A session that was started elsewhere, without the repository on its path."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, {str(Path(contract.__file__).parent)!r})
import __spark_entry__ as e
print("ROWS", e.queries()["batch_vector_topk"](spark, e.SMOKE).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS 75" in out.stdout, out.stderr[-2000:]


def test_registry_is_consistent():
    names = contract.queries()
    assert set(contract.oracle_sql()) <= set(names)
    if importlib.util.find_spec("ridgeline.llm") is None:
        assert not any(n.startswith("op") for n in names)


def test_nothing_outside_imports_the_optional_part():
    import ast
    from pathlib import Path

    root = Path(contract.__file__).parent
    for path in (root / "ridgeline").rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), path


def test_a_missing_library_leaves_the_engine(tmp_path):
    """Whatever the optional part needs and does not find, the engine's queries stay."""
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(contract.__file__).parent)
    for missing in ("xxhash", "ridgeline.llm", "corpus_pipeline"):
        code = f"import sys; sys.path.insert(0, {root!r}); sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print('OP' if 'op1_entropy_mix' in q else 'NONE', sum(not n.startswith('op') and n != 'pipeline' for n in q))"
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=100)
        from ridgeline import queries as core

        assert out.stdout.split()[-1] == str(len(core.queries())), out.stderr[-2000:]
