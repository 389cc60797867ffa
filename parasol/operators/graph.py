"""The walking graph: nodes, segments and edges from tiles, with the rules for what is given more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parasol.functions.geo import cumulative, length, line_exact, plane

FIRST = ["tile_ord", "pos"]


def first_nodes(nodes: DataFrame) -> DataFrame:
    """nid, lon, lat, x, y: the first loaded of each nid."""
    one = nodes.groupBy("nid").agg(F.min_by(F.struct("lon", "lat"), F.struct(*FIRST)).alias("n"))
    at = one.select("nid", "n.lon", "n.lat")
    return at.withColumn("p", plane(F.col("lon"), F.col("lat"))).select("nid", "lon", "lat", "p.x", "p.y")


def last_segments(segments: DataFrame) -> DataFrame:
    """One row for each i, the last loaded, at the place (ord) where i came first."""
    columns = [c for c in segments.columns if c not in ("i", *FIRST)]
    order = F.struct(*FIRST)
    rows = segments.groupBy("i").agg(F.max_by(F.struct(*columns), order).alias("s"), F.min(order).alias("ord"))
    return rows.select("i", "s.*", "ord")


def measured(segments: DataFrame, exact: bool = False) -> DataFrame:
    """Segments with their geometry in metres (line) and running lengths (cumul); exact: to the last bit of C's functions."""
    line = line_exact(F.col("geom")) if exact else F.transform("geom", lambda p: plane(p.lon, p.lat))
    return segments.withColumn("line", line).withColumn("cumul", cumulative(F.col("line")))


def _pair() -> list:
    return [F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")]


def edges(segments: DataFrame, crossings: DataFrame) -> DataFrame:
    """One edge for each unordered pair: lo, hi, kind, l, i, src.

    Of the segments between two nodes the highest i counts; a crossing counts only where there is none, and of
    crossings the first loaded.
    """
    walks = segments.groupBy(*_pair()).agg(F.max_by(F.struct("l", "i"), "i").alias("e"))
    walks = walks.select("lo", "hi", F.lit("trottoir").alias("kind"), "e.l", "e.i", F.lit(None).cast("string").alias("src"))
    over = crossings.groupBy(*_pair()).agg(F.min_by(F.struct("l", "src"), F.struct(*FIRST)).alias("e"))
    over = over.join(walks, ["lo", "hi"], "left_anti")
    over = over.select("lo", "hi", F.lit("traversee").alias("kind"), "e.l", F.lit(None).cast("int").alias("i"), "e.src")
    return walks.unionByName(over)


def both_ways(edges: DataFrame) -> DataFrame:
    """Directed edges u -> v; a loop comes once."""
    rest = [c for c in edges.columns if c not in ("lo", "hi")]
    there = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"), *rest)
    back = edges.where("lo <> hi").select(F.col("hi").alias("u"), F.col("lo").alias("v"), *rest)
    return there.unionByName(back)


def running_length(points: DataFrame, key: str, order: str) -> DataFrame:
    """Exploded points (x, y) with their distance from the first of their line."""
    w = Window.partitionBy(key).orderBy(order)
    step = length(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    rows = points.withColumn("step", F.coalesce(step, F.lit(0.0)))
    return rows.withColumn("s", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def tiles_in_reach(boxes: DataFrame, tiles: DataFrame, size: float, margin: float = 700.0) -> DataFrame:
    """Rows of boxes (x0, y0, x1, y1, any order) by the tiles (id "tx_ty") that their widened box overlaps.

    The cells of a box are listed and meet tiles by equality, so no box is compared with all tiles.
    """
    low = lambda a, b: F.least(a, b) - margin
    high = lambda a, b: F.greatest(a, b) + margin
    span = lambda a, b: F.explode(F.sequence(F.floor(low(a, b) / size).cast("int"), (F.ceil(high(a, b) / size) - 1).cast("int")))
    cells = boxes.withColumn("tx", span("x0", "x1")).withColumn("ty", span("y0", "y1"))
    part = F.split("id", "_")
    named = tiles.select(F.col("id").alias("tile"), F.get(part, F.lit(0)).cast("int").alias("tx"), F.get(part, F.lit(1)).cast("int").alias("ty"))
    return cells.join(named, ["tx", "ty"]).drop("tx", "ty")
