"""The rest of the library in a copy without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import __spark_entry__ as e, starloom.registry as r
assert set(e.queries()) == set(r.queries()) and set(e.oracle_sql()) == set(r.oracle_sql())
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
assert e.queries()["flt_language"](spark, "/root/testdata/sf0.001").columns == ["login", "id", "language"]
print("FINE")
"""


@pytest.mark.parametrize("gone", [["starloom/llm", "tests/llm"], ["starloom/llm", "tests/llm", "corpus_pipeline.py"]])
def test_rest_works_alone(tmp_path, gone):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    assert "FINE" in out.stdout, out.stderr[-2000:]
