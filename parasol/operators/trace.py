"""The line of a route, its stages by distance along it, and places and headings on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parasol.functions.geo import heading, length, let, plane, step_degrees


def by_sorting(rows: DataFrame) -> DataFrame:
    """rows of walks, to be joined by sorting. Spark guesses sizes without what explode and collect_list add, so a table
    that it takes for a small one and sends round by way of the driver may have all points of all walks."""
    return rows.hint("merge")


def stage_points(path: DataFrame, segments: DataFrame, nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Path edges (route_id, seq, de, vers, kind, i, src) -> their points (route_id, seq, pos, lon, lat, s, step).

    A sidewalk is turned round if walked from its b, and its ends lie on the nodes; other edges are straight.
    ends has route_id and the structs dep and arr (lon, lat), for the nodes -1 and -2. s runs along the route.
    """
    place = nodes.select("nid", F.struct("lon", "lat").alias("p"))
    at = lambda d, side: d.join(place.select(F.col("nid").alias(side), F.col("p").alias("p_" + side)), side, "left")
    rows = at(at(path, "de"), "vers").join(by_sorting(ends), "route_id")
    rows = rows.join(segments.select("i", F.col("b").alias("seg_b"), "geom"), "i", "left")
    own = lambda side: F.when(F.col(side) == -1, F.col("dep")).when(F.col(side) == -2, F.col("arr")).otherwise(F.col("p_" + side))
    first, last = own("de"), own("vers")
    line = F.when(F.col("de") == F.col("seg_b"), F.reverse("geom")).otherwise(F.col("geom"))
    inner = F.when(F.size(line) > 2, F.slice(line, 2, F.size(line) - 2)).otherwise(F.array().cast("array<struct<lon:double,lat:double>>"))
    walked = F.concat(F.array(F.coalesce(first, F.get(line, F.lit(0)))), inner, F.array(F.coalesce(last, F.element_at(line, -1))))
    straight = F.filter(F.array(first, last), lambda p: p.isNotNull())
    rows = rows.withColumn("pts", F.when(F.col("kind") == "trottoir", walked).otherwise(straight))
    flat = rows.select("route_id", "seq", F.posexplode("pts").alias("pos", "p")).select("route_id", "seq", "pos", "p.lon", "p.lat", plane(F.col("p.lon"), F.col("p.lat")).alias("m"))
    w = Window.partitionBy("route_id").orderBy("seq", "pos")
    same = (F.lag("lon").over(w) == F.col("lon")) & (F.lag("lat").over(w) == F.col("lat"))
    step = F.when(same, 0.0).otherwise(length(F.col("m.x") - F.lag("m.x").over(w), F.col("m.y") - F.lag("m.y").over(w)))
    flat = flat.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("again", F.coalesce(same, F.lit(False)))
    return flat.withColumn("s", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("m")


def stages(path: DataFrame, points: DataFrame, segments: DataFrame) -> DataFrame:
    """route_id, seq, s0, s1, kind, rue, cote, source, i: the stretch of the line that each edge takes."""
    ends = points.groupBy("route_id", "seq").agg(F.max("s").alias("s1"))
    w = Window.partitionBy("route_id").orderBy("seq")
    named = segments.select("i", F.nullif("rue", F.lit("")).alias("rue"), F.nullif("cote", F.lit("")).alias("cote"))
    rows = path.join(by_sorting(ends), ["route_id", "seq"]).join(named, "i", "left")
    rows = rows.withColumn("s0", F.coalesce(F.lag("s1").over(w), F.lit(0.0)))
    kind = F.when(F.col("kind") == "attache", "liaison").otherwise(F.col("kind"))
    return rows.select("route_id", "seq", "s0", "s1", kind.alias("kind"), "rue", "cote", F.col("src").alias("source"), "i", "step")


def traces(points: DataFrame) -> DataFrame:
    """route_id, pts (array of lon, lat, s without repeated points), longueur; a trace of one point is an error."""
    kept = points.where(~F.col("again"))
    rows = kept.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("seq", "pos", "lon", "lat", "s"))).alias("all"))
    rows = rows.select("route_id", F.transform("all", lambda p: F.struct(p.lon.alias("lon"), p.lat.alias("lat"), p.s.alias("s"))).alias("pts"))
    few = F.raise_error(F.lit("trace : au moins 2 points"))
    rows = rows.withColumn("pts", F.when(F.size("pts") >= 2, F.col("pts")).otherwise(few))
    return rows.withColumn("longueur", F.element_at("pts", -1).s)


def place(pts: Column, s: Column) -> Column:
    """Struct (lon, lat) at distance s along an array of (lon, lat, s), linear in degrees, clamped to its ends."""
    n = F.size(pts)
    end = lambda p: F.struct(p.lon.alias("lon"), p.lat.alias("lat"))

    def between(q: Column) -> Column:
        a, b = q.a, q.b
        r = F.when(b.s > a.s, (q.s - a.s) / (b.s - a.s)).otherwise(0.0)
        return F.struct((a.lon + (b.lon - a.lon) * r).alias("lon"), (a.lat + (b.lat - a.lat) * r).alias("lat"))

    # The first point from the second on that is not before s.
    k = F.least(n - 1, 1 + F.size(F.filter(F.slice(pts, 2, n), lambda p: p.s < s)))
    pair = let(k, lambda k: F.struct(F.get(pts, k - 1).alias("a"), F.get(pts, k).alias("b"), s.alias("s")))
    first, last = F.get(pts, F.lit(0)), F.element_at(pts, -1)
    return F.when(s <= 0, end(first)).when(s >= last.s, end(last)).otherwise(let(pair, between))


def _around(pts: Column, s: Column, half: float) -> Column:
    """Struct of the places (a, b) half a metre count before and after s, within the line."""
    a = place(pts, F.greatest(F.lit(0.0), s - half))
    b = place(pts, F.least(F.element_at(pts, -1).s, s + half))
    return F.struct(a.alias("a"), b.alias("b"))


def heading_at(pts: Column, s: Column) -> Column:
    """Heading of the line at s, between one metre before and after."""
    return let(_around(pts, s, 1.0), lambda q: heading(q.a.lon, q.a.lat, q.b.lon, q.b.lat))


def walking_direction(pts: Column, s: Column, half: float) -> Column:
    """Unit vector (x, y) in metres of the line around s; null if it does not move."""
    metres = let(_around(pts, s, half), lambda q: F.struct(plane(q.a.lon, q.a.lat).alias("p"), plane(q.b.lon, q.b.lat).alias("q")))
    step = let(metres, lambda m: F.struct((m.q.x - m.p.x).alias("x"), (m.q.y - m.p.y).alias("y")))
    n = lambda d: length(d.x, d.y)
    return let(step, lambda d: F.when(n(d) > 0, F.struct((d.x / n(d)).alias("x"), (d.y / n(d)).alias("y"))))


def walked(traces: DataFrame, detours: DataFrame, speed: float = 1.3, every_ms: int = 1000, noise_m: float = 0.0, seed: Column | None = None) -> DataFrame:
    """Positions of simulated walks along traces (route_id, pts, longueur).

    detours (route_id, a_m, longueur_m, cap_relatif_deg) leave the line and come back to it. A position's
    noise is a function of seed and its number, so positions are made in any order; a draw of exactly 0,
    where the generator's sequence would draw again, gives a null position.
    """
    from parasol.functions.chance import draw, normal

    d = detours.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("a_m", "longueur_m", "cap_relatif_deg"))).alias("detours"))
    rows = traces.join(by_sorting(d), "route_id", "left").withColumn("detours", F.coalesce("detours", F.array().cast("array<struct<a_m:double,longueur_m:double,cap_relatif_deg:double>>")))
    total = F.col("longueur") + F.aggregate("detours", F.lit(0.0), lambda a, e: a + 2 * e.longueur_m)
    step = speed * every_ms / 1000
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((total + 1e-9) / step).cast("int"))))
    rows = rows.withColumn("gone", F.col("k") * F.lit(step))
    # Walk through the detours in order: metres left to place, metres of line used, the detour one is on.
    state = F.struct(F.col("gone").alias("left"), F.lit(0.0).alias("used"), F.lit(None).cast("struct<a_m:double,longueur_m:double,cap_relatif_deg:double>").alias("on"), F.lit(False).alias("stop"))

    def pass_(acc: Column, e: Column) -> Column:
        reach = acc.left - (e.a_m - acc.used)
        before, inside = reach < 0, reach < 2 * e.longueur_m
        make = lambda left, used, on, stop: F.struct(left.alias("left"), used.alias("used"), on.alias("on"), stop.alias("stop"))
        return F.when(acc.stop | before, make(acc.left, acc.used, acc.on, F.lit(True))).when(inside, make(reach, e.a_m, e, F.lit(True))).otherwise(make(reach - 2 * e.longueur_m, e.a_m, acc.on, acc.stop))

    rows = rows.withColumn("at", F.aggregate("detours", state, pass_))
    on = F.col("at.on")
    off = F.when(F.col("at.left") <= on.longueur_m, F.col("at.left")).otherwise(2 * on.longueur_m - F.col("at.left"))
    s = F.when(on.isNotNull(), on.a_m).otherwise(F.least(F.col("at.used") + F.col("at.left"), F.col("longueur")))
    rows = rows.withColumn("s", s).withColumn("off", F.when(on.isNotNull(), off).otherwise(0.0)).withColumn("base", place(F.col("pts"), F.col("s")))
    side = F.radians(heading_at(F.col("pts"), F.col("s")) + F.coalesce(on.cap_relatif_deg, F.lit(90.0)))
    east, north = step_degrees(F.col("base.lat"))
    out = on.isNotNull()
    rows = rows.withColumn("true_lon", F.col("base.lon") + F.when(out, F.col("off") * F.sin(side) * east).otherwise(0.0))
    rows = rows.withColumn("true_lat", F.col("base.lat") + F.when(out, F.col("off") * F.cos(side) * north).otherwise(0.0)).withColumn("hors_trace", out)
    w = Window.partitionBy("route_id").orderBy("k")
    east, north = step_degrees(F.col("true_lat"))
    dx, dy = (F.col("true_lon") - F.lag("true_lon").over(w)) / east, (F.col("true_lat") - F.lag("true_lat").over(w)) / north
    cap = F.when(length(dx, dy) > 0.2, (F.degrees(F.atan2(dx, dy)) + 360) % 360)
    seed = F.lit(1) if seed is None else seed
    n = lambda j: normal(draw(seed, 4 * F.col("k") + j), draw(seed, 4 * F.col("k") + j + 1))
    lon = F.col("true_lon") + n(1) * noise_m * east if noise_m else F.col("true_lon")
    lat = F.col("true_lat") + n(3) * noise_m * north if noise_m else F.col("true_lat")
    accuracy = float(int(noise_m * 1.5 + 0.5)) if noise_m else 5.0
    rows = rows.withColumn("cap", cap)
    return rows.select(
        F.col("route_id").alias("walk_id"), "k", lon.alias("lon"), lat.alias("lat"), F.lit(accuracy).alias("precision_m"), (F.col("k").cast("long") * every_ms).alias("t_ms"),
        "cap", F.when(F.col("cap").isNull(), 0.0).otherwise(speed).alias("vitesse"), "s", "hors_trace", F.col("off").alias("ecart_m"),
    )
