"""Shade along a route and across the street: bands, means, whether the sunny side needs a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parasol.functions.geo import SCREEN_DEGREE, half_up, side_of
from parasol.functions.shade import UNKNOWN, shaded
from parasol.functions.shade import shade as share
from parasol.operators.trace import by_sorting, place, walking_direction

BAND_M, WINDOW_M, LEAST_WINDOW_M, CONTRAST = 150.0, 50.0, 15.0, 0.3
NARROW_M = 12.0


def with_shade(stages: DataFrame, shade: DataFrame, face: DataFrame, face_at_departure: bool = True) -> DataFrame:
    """Stages with o (share in shade of the sidewalk), i_face, and o_face (of the one opposite).

    Both are read at the stage's step; in bands the opposite side counts at the step of departure unless the
    route walks it. Undetermined and missing values are null.
    """
    at = lambda i, j, name: shade.select(F.col("i").alias(i), F.col("j").alias(j), share(F.col("val")).alias(name))
    rows = stages.join(at("i", "step", "o"), ["i", "step"], "left").join(face.select("i", "i_face", F.col("distance_m").alias("face_m")), "i", "left")
    if face_at_departure:
        own = stages.where("i is not null").groupBy("route_id", F.col("i").alias("i_face")).agg(F.max("step").alias("own_step"))
        rows = rows.join(by_sorting(own), ["route_id", "i_face"], "left").withColumn("face_step", F.coalesce("own_step", "start_step")).drop("own_step")
    else:
        rows = rows.withColumn("face_step", F.col("step"))
    return rows.join(at("i_face", "face_step", "o_face"), ["i_face", "face_step"], "left")


def band(places: DataFrame, shaded_stages: DataFrame, horizon: Column | float = BAND_M) -> DataFrame:
    """Stretches of both sides of the street from s to s + horizon: what of each stage lies within, and its shade."""
    reach = horizon if isinstance(horizon, Column) else F.lit(horizon)
    p = places.withColumn("end", F.least(F.col("longueur"), F.col("s") + reach))
    met = p.join(by_sorting(shaded_stages.drop("longueur")), "route_id").where((F.col("s1") > F.col("s")) & (F.col("s0") < F.col("end")))
    met = met.withColumn("d0", F.greatest("s0", "s")).withColumn("d1", F.least("s1", "end")).where("d1 > d0")
    walk = F.col("kind") == "trottoir"
    return met.withColumn("known", walk).withColumn("known_face", walk & F.col("i_face").isNotNull())


def mean_shade(metres: Column, walk: Column, known: Column, value: Column) -> Column:
    """Aggregate: length-weighted share in shade of what is known, undetermined counting as shade; null if that is under half."""
    counted = F.sum(F.when(walk & known, metres).otherwise(0.0))
    dark = F.sum(F.when(walk & known, F.coalesce(value, F.lit(1.0)) * metres).otherwise(0.0))
    return F.when((F.sum(metres) > 0) & (counted >= 0.5 * F.sum(metres)), dark / counted)


def contrast(places: DataFrame, shaded_stages: DataFrame, window: float = WINDOW_M) -> DataFrame:
    """places (route_id, s, longueur) with the shade of both sides up to the next crossing, and whether the other is clearly darker.

    A place meets its walk's stages as one array, so that places are made, dealt and joined once; means are as in mean_shade().
    """
    walk = F.col("kind") == "trottoir"
    stage = F.struct("seq", "s0", "s1", (F.col("kind") == "traversee").alias("cross"), walk.alias("known"), (walk & F.col("i_face").isNotNull()).alias("known_face"), "o", "o_face")
    p = places.join(by_sorting(shaded_stages.groupBy("route_id").agg(F.array_sort(F.collect_list(stage)).alias("rows"))), "route_id", "left")
    s = F.col("s")
    nxt = F.array_min(F.transform(F.filter("rows", lambda x: x.cross & (x.s0 > s)), lambda x: x.s0))
    p = p.withColumn("horizon", F.least(F.lit(window), F.coalesce(nxt - s, F.lit(window)))).withColumn("end", F.least(F.col("longueur"), s + F.col("horizon")))
    met = F.filter("rows", lambda x: (x.s1 > s) & (x.s0 < F.col("end")))
    met = F.transform(met, lambda x: F.struct((F.least(x.s1, F.col("end")) - F.greatest(x.s0, s)).alias("m"), x.known.alias("known"), x.known_face.alias("known_face"), x.o.alias("o"), x.o_face.alias("o_face")))
    p = p.withColumn("met", F.when(F.col("horizon") >= LEAST_WINDOW_M, F.filter(met, lambda x: x.m > 0)))
    total = lambda f: F.aggregate("met", F.lit(0.0), lambda a, x: a + f(x))
    p = p.withColumn("metres", total(lambda x: x.m))
    for known, value in (("known", "o"), ("known_face", "o_face")):
        p = p.withColumn("counted", total(lambda x: F.when(x[known], x.m).otherwise(0.0)))
        dark = total(lambda x: F.when(x[known], F.coalesce(x[value], F.lit(1.0)) * x.m).otherwise(0.0))
        p = p.withColumn("mean_" + value, F.when((F.col("metres") > 0) & (F.col("counted") >= 0.5 * F.col("metres")), dark / F.col("counted")))
    active = F.coalesce(F.col("mean_o_face") - F.col("mean_o") > CONTRAST, F.lit(False))
    return p.select(*places.columns, "horizon", F.col("mean_o").alias("ombre_suivi"), F.col("mean_o_face").alias("ombre_en_face"), active.alias("actif"))


def after_crossing(places: DataFrame, shaded_stages: DataFrame) -> DataFrame:
    """The same question just beyond the next crossing, if there is one: crossing_s0, distance_m, and contrast()'s columns."""
    cross = shaded_stages.where("kind = 'traversee'").groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("seq", "s0", "s1"))).alias("crossings"))
    p = places.join(cross, "route_id", "left")
    nxt = F.get(F.filter("crossings", lambda x: x.s1 > F.col("s")), F.lit(0))
    p = p.withColumn("c", nxt).withColumn("asked", F.coalesce(F.col("c.s1") + 0.01, F.col("s")))
    there = p.select("route_id", F.col("asked").alias("s"), "longueur").distinct()
    seen = contrast(there, shaded_stages).select("route_id", F.col("s").alias("asked"), "ombre_suivi", "ombre_en_face", "actif")
    out = p.join(seen, ["route_id", "asked"], "left")
    return out.select(*places.columns, F.col("c.s0").alias("traversee_s0"), F.greatest(F.lit(0.0), F.col("c.s0") - F.col("s")).alias("distance_m"), "ombre_suivi", "ombre_en_face", "actif")


def reasons(places: DataFrame, shaded_stages: DataFrame) -> DataFrame:
    """places (route_id, s, longueur) with how long the sun lasts (soleil_m), metres to the next crossing, and shade after it.

    A change of shade counts only if the next sidewalk before a crossing agrees.
    """
    w = Window.partitionBy("route_id").orderBy("seq")
    on = w.rowsBetween(1, Window.unboundedFollowing)
    walk, cross = F.col("kind") == "trottoir", F.col("kind") == "traversee"
    rows = shaded_stages.withColumn("dark", shaded(F.col("o")))
    nxt = F.first(F.when(cross, F.struct(F.lit(True).alias("cross"), F.lit(False).alias("dark"))).when(walk, F.struct(F.lit(False).alias("cross"), F.col("dark").alias("dark"))), True).over(on)
    agrees = nxt.isNull() | nxt.cross | (nxt.dark == F.col("dark"))
    rows = rows.withColumn("durable", walk & agrees)
    arr = rows.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("seq", "s0", "s1", "kind", "dark", "durable"))).alias("rows"))
    p = places.join(by_sorting(arr), "route_id")
    s, all_ = F.col("s"), F.col("rows")
    hit = F.array_position(F.transform(all_, lambda x: (s >= x.s0) & (s < x.s1)), True) - 1
    p = p.withColumn("at", F.when(hit >= 0, hit).otherwise(F.size(all_) - 1).cast("int"))
    ahead = F.slice("rows", F.col("at") + 1, F.size("rows"))
    p = p.withColumn("ahead", ahead)
    k = F.array_position(F.transform("ahead", lambda x: x.kind == "traversee"), True).cast("int")  # 1-based, 0 if none
    p = p.withColumn("k", k)
    until = F.when(F.col("k") > 0, F.slice("ahead", 1, F.greatest(F.col("k") - 1, F.lit(0)))).otherwise(F.col("ahead"))
    dark_from = F.get(F.filter(until, lambda x: (x.s0 > s) & x.durable & x.dark), F.lit(0)).s0 - s
    crossing = F.when(F.col("k") > 0, F.greatest(F.lit(0.0), F.element_at("ahead", F.when(F.col("k") > 0, F.col("k"))).s0 - s))
    p = p.withColumn("dark_from", dark_from).withColumn("traversee_m", crossing)
    beyond = F.slice("ahead", F.col("k") + 1, F.size("ahead"))
    p = p.withColumn("beyond", F.when(F.col("k") > 0, beyond).otherwise(F.slice("ahead", 1, 0)))
    stop = F.array_position(F.transform("beyond", lambda x: (x.kind == "traversee") | (x.durable & ~x.dark)), True).cast("int")
    run = F.when(stop > 0, F.slice("beyond", 1, F.greatest(stop - 1, F.lit(0)))).otherwise(F.col("beyond"))
    after = F.aggregate(F.filter(run, lambda x: x.kind == "trottoir"), F.lit(0.0), lambda a, x: a + (x.s1 - x.s0))
    sun = F.when(F.col("traversee_m").isNull(), F.coalesce("dark_from", F.col("longueur") - s)).otherwise(F.least(F.coalesce("dark_from", "traversee_m"), "traversee_m"))
    return p.select(*places.columns, sun.alias("soleil_m"), "traversee_m", after.alias("ombre_apres_m"))


def side_to_walk(places: DataFrame, stages: DataFrame, segments: DataFrame, face: DataFrame, traces: DataFrame) -> DataFrame:
    """places (route_id, s) with the side of the street to walk on and how it was told: by the side's compass point
    and the heading within 5, then 15 metres, else by where the opposite sidewalk lies."""
    from parasol.operators.instructions import stage_at

    met = stage_at(places, stages).join(segments.select("i", "cote", F.get("line", F.floor(F.size("line") / 2).cast("int")).alias("mid")).withColumnRenamed("cote", "side"), "i", "left")
    met = met.join(face.select("i", "i_face"), "i", "left").join(segments.select(F.col("i").alias("i_face"), F.get("line", F.floor(F.size("line") / 2).cast("int")).alias("mid_face")), "i_face", "left")
    met = met.join(by_sorting(traces), "route_id")
    at = F.least(F.greatest("s", "walk_s0"), "walk_s1")
    met = met.withColumn("near", walking_direction(F.col("pts"), at, 5.0)).withColumn("wide", walking_direction(F.col("pts"), at, 15.0))
    x = F.when(F.col("side") == "est", 1.0).when(F.col("side") == "ouest", -1.0).when(F.col("side").isin("nord", "sud"), 0.0)
    y = F.when(F.col("side") == "nord", 1.0).when(F.col("side") == "sud", -1.0).when(F.col("side").isin("est", "ouest"), 0.0)
    compass = side_of(F.col("near.x"), F.col("near.y"), x, y)
    smooth = side_of(F.col("wide.x"), F.col("wide.y"), x, y)
    other = side_of(F.col("near.x"), F.col("near.y"), F.col("mid_face.x") - F.col("mid.x"), F.col("mid_face.y") - F.col("mid.y"))
    geometric = F.when(other == "gauche", "droite").when(other == "droite", "gauche")
    method = F.when(compass.isNotNull(), "boussole").when(smooth.isNotNull(), "boussole_lissee").when(geometric.isNotNull(), "geometrie")
    return met.select(*places.columns, F.coalesce(compass, smooth, geometric).alias("cote"), method.alias("methode"), F.col("side").alias("cote_boussole"), "rue", "i_face")


def street_trace(shaded_stages: DataFrame, traces: DataFrame, segments: DataFrame) -> DataFrame:
    """Stages as drawn: class of the better side of a narrow street, and the line, moved to its axis, every two metres."""
    rows = shaded_stages.join(traces.select("route_id", "pts"), "route_id").join(segments.select("i", F.col("cote").alias("side")), "i", "left")
    walk = F.col("kind") == "trottoir"
    own = F.coalesce("o", F.lit(1.0))
    narrow = walk & F.coalesce(F.col("face_m") <= NARROW_M, F.lit(False))
    best = F.when(narrow, F.greatest(own, F.coalesce("o_face", F.lit(1.0)))).otherwise(own)
    name = F.when(~walk, F.col("kind")).when(best >= 0.5, "ombre").otherwise("soleil")
    n = F.greatest(F.lit(0), F.ceil((F.col("s1") - F.col("s0")) / 2) - 1).cast("int")
    along = F.when(F.col("s1") > F.col("s0"), F.transform(F.sequence(F.lit(0), n), lambda k: F.col("s0") + 2.0 * k)).otherwise(F.array().cast("array<double>"))
    line = F.transform(F.concat(along, F.array("s1")), lambda s: place(F.col("pts"), s))
    rows = rows.withColumn("line", line).where(F.size("line") >= 2)
    x = F.when(F.col("side") == "est", 1.0).when(F.col("side") == "ouest", -1.0).otherwise(0.0)
    y = F.when(F.col("side") == "nord", 1.0).when(F.col("side") == "sud", -1.0).otherwise(0.0)
    lat0 = F.get("line", F.lit(0)).lat
    east, north = 1 / (SCREEN_DEGREE * F.cos(F.radians(lat0))), 1 / SCREEN_DEGREE
    moved = F.transform("line", lambda p: F.struct((p.lon - x * F.col("face_m") * east / 2).alias("lon"), (p.lat - y * F.col("face_m") * north / 2).alias("lat")))
    return rows.select("route_id", "seq", "s0", "s1", "kind", name.alias("classe"), F.when(walk, own).alias("own"), F.when(walk, best).alias("best"), F.when(narrow, moved).otherwise(F.col("line")).alias("line"))


def street_shares(trace: DataFrame) -> DataFrame:
    """Per cent in shade of the side walked and of the street, by route; null without sidewalk."""
    m = F.when(F.col("kind") == "trottoir", F.col("s1") - F.col("s0")).otherwise(0.0)
    pct = lambda c: F.when(F.sum(m) > 0, half_up(100 * F.sum(m * F.coalesce(c, F.lit(0.0))) / F.sum(m)))
    return trace.groupBy("route_id").agg(pct("best").alias("pct_rue"), pct("own").alias("pct_cote"))


def sidewalk_layer(segments: DataFrame, shade: DataFrame, hhmm: str) -> DataFrame:
    """Sidewalks with shade at a time as GeoJSON features; a time without shade is an error."""
    at = shade.where(F.col("hhmm") == hhmm)
    if at.isEmpty():
        raise ValueError(f"no shade at {hhmm}")
    rows = segments.join(at.select("i", "val", "low_conf"), "i")
    line = F.transform("geom", lambda p: F.array(p.lon, p.lat))
    props = F.struct(
        F.when(F.col("val") != UNKNOWN, F.col("val") / 100).alias("fraction_ombre"), (F.col("val") == UNKNOWN).alias("indetermine"), (F.col("low_conf") == 1).alias("confiance_faible")
    )
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"), props.alias("properties"))
    return rows.select("i", "val", "low_conf", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))
