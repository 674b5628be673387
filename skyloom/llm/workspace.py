"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one of this machine only where none is set and all tasks run here (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("skyloom.scratch.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="skyloom-")
        spark.conf.set("skyloom.scratch.dir", where)
    return where.rstrip("/")


def materialise(spark: SparkSession, df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which also cuts its lineage.

    Unlike ``checkpoint()`` this computes ``df`` a single time, and a lost executor
    costs nothing that has been written.
    """
    path = f"{shared_dir(spark)}/skyloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    # shuffles that no plan refers to any more are deleted when the driver collects garbage
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.skyloom_path = path
    return out


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by ``materialise`` that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(df.skyloom_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
