"""Tables in the folder that driver and executors share, to cut lineage or to fix a partitioning."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and all runs on this machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="braidwork-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(made)
        root = spark.sparkContext.getCheckpointDir()
    return root


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet below the shared folder (removed when the driver's JVM exits) and read it back."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/braidwork/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for path in {os.path.dirname(f) for f in df.inputFiles()}:
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def plan_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of df's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
