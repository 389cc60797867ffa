"""What the corpus operators share: intermediate tables, row identity and word rules."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parasol.sources.lineage import own_folder

#: ASCII white space; a word is a run of anything else.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local sessions, one of our own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = own_folder(spark)
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: nothing is left to tidy with
        pass


def keep(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and a lost executor costs one reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parasol-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of df's (case does not matter to Spark)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def lower_ascii(c: Column) -> Column:
    """A-Z only: other letters keep their case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def batched(spark: SparkSession, n: int = 512) -> None:
    """Rows in an Arrow batch handed to Python: texts may be long, so batches are short. No result depends on it."""
    spark.conf.set(BATCH, str(n))


@contextmanager
def batch_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """So many rows in an Arrow batch for what runs inside; then as before."""
    usual = spark.conf.get(BATCH)
    batched(spark, n)
    try:
        yield
    finally:
        spark.conf.set(BATCH, usual)
