"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def own_folder(spark: SparkSession) -> str:
    """A folder of this machine, for sessions without spark.checkpoint.dir; on a cluster nobody else could read it."""
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="parasol-")


def cut(df: DataFrame) -> DataFrame:
    """df written by checkpoint() to spark.checkpoint.dir (in local sessions to a folder of its own where that is unset)."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own_folder(spark))
    return df.checkpoint()
