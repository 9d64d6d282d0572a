"""Kernels run on workers that cannot import the package."""

from __future__ import annotations

import pathlib
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession

queries = entry.queries()
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", queries["rrf_fuse"](spark, {data!r}).count())
"""


def test_workers_need_no_package(tmp_path, small):
    root = str(pathlib.Path(__file__).resolve().parents[1])
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=root, data=small))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows 200" in done.stdout, done.stderr[-2000:]
