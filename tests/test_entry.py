"""The entry module, with and without the subpackage of text operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_text_operators(tmp_path):
    shutil.copytree(f"{ROOT}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "tessera/llm/__pycache__").mkdir(parents=True)  # what may stay of a folder
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), any(k.startswith('op') for k in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    n, sql, op, pipeline = out.stdout.split()
    assert int(n) >= 40 and (sql, op, pipeline) == ("True", "False", "False"), out.stderr


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    queries = entry.queries()
    if entry._HAS_LLM:
        assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in queries} and "pipeline" in queries
    assert set(entry.oracle_sql()) <= set(queries)


def test_flagship(spark):
    import __spark_entry__ as entry

    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
