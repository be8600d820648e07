"""Queries on workers that lack the package: the driver finds it by sys.path, the workers' folder and PYTHONPATH don't have it."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "shared").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def missing(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("braidwork") is None])], names=["missing"])
assert spark.range(1).mapInArrow(missing, "missing boolean").first().missing
import __spark_entry__ as entry
for name in {names!r}:
    assert entry.queries()[name](spark, {data!r}).count() > 0, name
    print("done", name)
"""


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the tables are not here")
def test_workers_without_the_package(tmp_path):
    names = ["op1_packing", "op2_neighbours", "op3_mixing", "op4_chat", "op5_language_id", "op6_jaccard", "op7_repeats", "op8_quality", "op9_sharding", "op10_exact_dedup", "pipeline", "source_create"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != ROOT)}
    run = subprocess.run([sys.executable, "-c", RUN.format(root=str(ROOT), names=names, data="/root/testdata/sf0.001")], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert run.returncode == 0, run.stdout + run.stderr[-3000:]
    assert run.stdout.count("done") == len(names)
