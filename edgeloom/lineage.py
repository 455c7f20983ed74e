"""Cutting the lineage of tables that are used again and again, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names. In a session of one process without one, a new one is taken; on a
    cluster that is an error, for each machine would have its own."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="edgeloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder, so that a lost executor costs a task."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
