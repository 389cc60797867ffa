"""The deviation detector's sliding measures as windows over a table of fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parasol.functions.geo import length


def _ordered(key: str):
    return Window.partitionBy(key).orderBy("t_ms")


def drift(rows: DataFrame, key: str = "walk_id", seconds: int = 20, least_m: float = 12.0) -> DataFrame:
    """Heading and distance from the oldest fix in the last `seconds` to this one; null if alone or too near."""
    w = _ordered(key).rangeBetween(-seconds * 1000, 0)
    x0, y0, n = F.first("x").over(w), F.first("y").over(w), F.count(F.lit(1)).over(w)
    rows = rows.withColumns({"dx": F.col("x") - x0, "dy": F.col("y") - y0, "n": n})
    d = length(F.col("dx"), F.col("dy"))
    far = (F.col("n") >= 2) & (d >= least_m)
    return rows.withColumn("deplacement_m", F.when(far, d)).withColumn("cap_reel", F.when(far, F.degrees(F.atan2("dx", "dy")))).drop("dx", "dy", "n")


def mean_distance(rows: DataFrame, key: str = "walk_id", seconds: int = 20, least: int = 5) -> DataFrame:
    """Mean distance to the trace over the last `seconds`; null with fewer than `least` fixes."""
    w = _ordered(key).rangeBetween(-seconds * 1000, 0)
    return rows.withColumn("moyenne", F.when(F.count("off_m").over(w) >= least, F.avg("off_m").over(w)))


def all_deviate(rows: DataFrame, key: str = "walk_id", seconds: int = 8, degrees: float = 35.0) -> DataFrame:
    """Whether every fix of the last `seconds` is off the trace's heading."""
    w = _ordered(key).rangeBetween(-seconds * 1000, 0)
    return rows.withColumn("tous_devient", F.min("dev").over(w) >= degrees)


def displayed_for(rows: DataFrame, name: str, key: str = "walk_id") -> DataFrame:
    """Milliseconds for which the value of `name` has been the same without a break."""
    w = _ordered(key)
    before = F.lag(name).over(w)
    rows = rows.withColumn("_new", (F.row_number().over(w) == 1) | ~before.eqNullSafe(F.col(name)))
    rows = rows.withColumn("_run", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("depuis_ms", F.col("t_ms") - F.min("t_ms").over(Window.partitionBy(key, "_run"))).drop("_new", "_run")


def stops(rows: DataFrame, key: str = "walk_id", seconds: int = 180) -> DataFrame:
    """Visits: rows of a key with gaps under `seconds` between them (start, end, n)."""
    s = rows.groupBy(key, F.session_window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("fin"))
    return s.select(key, F.col("w.start").alias("debut"), "fin", "n")
