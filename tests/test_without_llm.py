"""What is left when the optional part is deleted imports, lists its queries and runs one."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_rest_stands_alone(tmp_path):
    shutil.copytree(REPO / "docloom", tmp_path / "docloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
assert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
assert e.entry(spark).count() > 0
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=180, env={**__import__("os").environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr[-2_000:]
