"""Points and sidewalks: nearest, within a radius, on a street. Grid cells make every join an equality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parasol.functions.geo import along, length
from parasol.sources.lineage import cut

CELL = 50.0  # fixed value: cells of the street index
RING = 16.0  # first ring in which a point's sidewalk is sought


def strips(segments: DataFrame) -> DataFrame:
    """Measured segments -> one row for each stretch between two vertices (i, p, ax, ay, bx, by, at)."""
    keep = [c for c in segments.columns if c not in ("geom", "line", "cumul")]
    rows = segments.where(F.size("line") > 1).select(*keep, "line", "cumul", F.explode(F.sequence(F.lit(1), F.size("line") - 1)).alias("p"))
    a, b = F.get("line", F.col("p") - 1), F.get("line", F.col("p"))
    return rows.select(
        *keep, "p", a.x.alias("ax"), a.y.alias("ay"), b.x.alias("bx"), b.y.alias("by"),
        F.get("cumul", F.col("p") - 1).alias("at"), F.element_at("cumul", -1).alias("whole"),
    )


def _cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))
    return F.explode(F.flatten(F.transform(span(x0, x1), lambda cx: F.transform(span(y0, y1), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy"))))))


def _projected(pairs: DataFrame) -> DataFrame:
    t = along(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    rows = pairs.withColumn("t", t).withColumn("px", F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax")))
    rows = rows.withColumn("py", F.col("ay") + F.col("t") * (F.col("by") - F.col("ay")))
    return rows.withColumn("d", length(F.col("x") - F.col("px"), F.col("y") - F.col("py")))


def nearby(points: DataFrame, stretches: DataFrame, radius: float) -> DataFrame:
    """Every point (key columns, x, y) by every stretch at most radius away; d, t, px, py added."""
    cell = _cells(F.col("x") - radius, F.col("y") - radius, F.col("x") + radius, F.col("y") + radius, radius)
    p = points.withColumn("cell", cell)
    s = stretches.withColumn("cell", _cells(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), radius))
    met = _projected(p.join(s, "cell")).where(F.col("d") <= radius)
    keys = [c for c in met.columns if c not in ("cell",)]
    return met.select(*keys).dropDuplicates([*points.columns, "i", "p"])


def attach(points: DataFrame, stretches: DataFrame, key: str, scope: Column | None = None) -> DataFrame:
    """The nearest sidewalk of every point (key, x, y): i, projection_m, rest_m, px, py, distance_m.

    Ties go to the segment loaded first, then to the earlier stretch. Points with nothing within a ring are
    sought again in one eight times as wide, until all are found or the ring is as wide as all points and stretches
    together; only those few take part again, written to the checkpoint folder. Without any segment in scope a point
    has no row.
    """
    out, left, radius, widest = None, points, RING, math.inf
    order = F.struct("d", F.col("ord"), "p")
    while True:
        cell = _cells(F.col("x") - radius, F.col("y") - radius, F.col("x") + radius, F.col("y") + radius, radius)
        s = stretches.withColumn("cell", _cells(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), radius))
        met = _projected(left.withColumn("cell", cell).join(s, "cell"))
        if scope is not None:
            met = met.where(scope)
        pick = F.struct("i", "a", "b", (F.col("at") + F.col("t") * length(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("projection_m"), "whole", "px", "py", "d")
        best = met.where(F.col("d") <= radius).groupBy(key).agg(F.min_by(pick, order).alias("n"))
        best = best.select(key, "n.i", "n.a", "n.b", "n.projection_m", (F.col("n.whole") - F.col("n.projection_m")).alias("rest_m"), "n.px", "n.py", F.col("n.d").alias("distance_m"))
        out = best if out is None else out.unionByName(best)
        left = cut(left.join(best.select(key), key, "left_anti"))
        if radius >= widest or left.isEmpty():
            return out
        radius *= 8
        if widest == math.inf:
            widest = _extent(left.select("x", "y").unionByName(stretches.select(F.col("ax").alias("x"), F.col("ay").alias("y"))).unionByName(stretches.select(F.col("bx").alias("x"), F.col("by").alias("y"))))


def _extent(places: DataFrame) -> float:
    """The diagonal of the box of all places: no two are farther apart."""
    x0, x1, y0, y1 = places.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    return math.hypot(x1 - x0, y1 - y0) + 1.0 if x0 is not None else 0.0


def followed_street(fixes: DataFrame, segments: DataFrame, key: str, expected: str = "expected") -> DataFrame:
    """For each fix (key, x, y, expected: array of streets): nearest sidewalk of the 3 x 3 cells round it, and the
    distance of the nearest of an expected street.

    A segment lies in the cells of its first, last and middle vertex only, and goes to the cells round these, so that
    a fix meets each stretch once. The least distances come first, which need no sorting of pairs; what lies at the
    least distance is sought in the same pairs again.
    """
    n = F.size("line")
    ends = F.array(F.get("line", F.lit(0)), F.get("line", n - 1), F.get("line", F.floor(n / 2).cast("int")))
    cell = lambda x, y: F.struct(F.floor(x / CELL).alias("cx"), F.floor(y / CELL).alias("cy"))
    round_ = F.flatten(F.transform(ends, lambda p: F.array(*[F.struct((F.floor(p.x / CELL) + a).alias("cx"), (F.floor(p.y / CELL) + b).alias("cy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])))
    s = strips(segments.withColumn("cells", F.array_distinct(round_))).withColumn("cell", F.explode("cells")).drop("cells")
    pairs = lambda p: _projected(p.withColumn("cell", cell(F.col("x"), F.col("y"))).join(s, "cell"))
    awaited = F.min(F.when(F.array_contains(expected, F.col("rue")), F.col("d"))).alias("d_expected")
    least = pairs(fixes.repartition(key)).groupBy(*fixes.columns).agg(F.min("d").alias("d_least"), awaited)
    met = pairs(least).where(F.col("d") == F.col("d_least"))
    near = F.min_by(F.struct("i", F.nullif("rue", F.lit("")).alias("rue"), F.nullif("cote", F.lit("")).alias("cote"), "d"), F.struct("d", "ord")).alias("n")
    return met.groupBy(key).agg(near, F.min("d_expected").alias("d_expected")).select(key, "n.*", "d_expected")


def within_reach(segments: DataFrame, trace: DataFrame, margin: float = 250.0) -> DataFrame:
    """Segments whose middle vertex is within margin of the bounding box of trace (x, y)."""
    box = trace.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    mid = F.get("line", F.floor(F.size("line") / 2).cast("int"))
    inside = mid.x.between(F.col("x0") - margin, F.col("x1") + margin) & mid.y.between(F.col("y0") - margin, F.col("y1") + margin)
    return segments.join(F.broadcast(box), inside).drop("x0", "x1", "y0", "y1")  # one row


def facing(segments: DataFrame, most: float = 30.0, parallel_deg: float = 35.0) -> DataFrame:
    """The sidewalk opposite each segment: same street, another side, parallel, on the far side, nearest within reach.

    Candidates meet by street and by cells as wide as the reach, so a street that fills the table is no hot key.
    """
    from parasol.functions.geo import polyline_distance

    named = segments.where((F.coalesce("rue", F.lit("")) != "") & (F.coalesce("cote", F.lit("")) != ""))
    first, last = F.get("line", F.lit(0)), F.element_at("line", -1)
    norm = length(last.x - first.x, last.y - first.y)
    mid = F.get("line", F.floor(F.size("line") / 2).cast("int"))
    shape = named.select(
        "i", "rue", "cote", "ord", "line", mid.alias("mid"),
        F.when(norm > 0, F.struct(((last.x - first.x) / norm).alias("x"), ((last.y - first.y) / norm).alias("y"))).alias("way"),
    )
    lows = lambda axis, f: f(F.transform("line", lambda p: p[axis]))
    box = [lows("x", F.array_min), lows("y", F.array_min), lows("x", F.array_max), lows("y", F.array_max)]
    other = shape.withColumn("cell", _cells(*box, most)).select("rue", "cell", *[F.col(c).alias("o_" + c) for c in ("i", "cote", "ord", "line", "mid", "way")])
    own = shape.withColumn("cell", _cells(mid_x := F.col("mid.x") - most, mid_y := F.col("mid.y") - most, mid_x + 2 * most, mid_y + 2 * most, most))
    met = own.join(other, ["rue", "cell"]).where((F.col("i") != F.col("o_i")) & (F.col("cote") != F.col("o_cote")))
    cosine = F.abs(F.col("way.x") * F.col("o_way.x") + F.col("way.y") * F.col("o_way.y"))
    met = met.where(F.col("way").isNull() | F.col("o_way").isNull() | (cosine >= F.cos(F.radians(F.lit(parallel_deg)))))
    out_x = F.when(F.col("cote") == "est", 1).when(F.col("cote") == "ouest", -1).otherwise(0)
    out_y = F.when(F.col("cote") == "nord", 1).when(F.col("cote") == "sud", -1).otherwise(0)
    far = (F.col("o_mid.x") - F.col("mid.x")) * out_x + (F.col("o_mid.y") - F.col("mid.y")) * out_y <= 0
    d = polyline_distance(F.col("mid.x"), F.col("mid.y"), F.col("o_line"))
    met = met.where(far).withColumn("d", d).where(F.col("d") <= most)
    best = met.groupBy("i").agg(F.min_by(F.struct("o_i", "o_cote", "d"), F.struct("d", "o_ord")).alias("n"))
    return best.select("i", F.col("n.o_i").alias("i_face"), F.col("n.o_cote").alias("cote_face"), F.col("n.d").alias("distance_m"))
