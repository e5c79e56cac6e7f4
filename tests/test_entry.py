"""The driver's entry works on a tree without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASKS = """
import __spark_entry__ as e
assert "rate" in e.queries() and "rate" in e.oracle_sql()
assert not any(k.startswith("op") and k[2].isdigit() for k in e.queries()), sorted(e.queries())
assert "pipeline" not in e.queries()
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(s).columns
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_operators(tmp_path, pipeline):
    tree = tmp_path / "tree"
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tree, ignore=skip)
    if not pipeline and (tree / "corpus_pipeline.py").exists():
        (tree / "corpus_pipeline.py").unlink()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ASKS], cwd=tree, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
