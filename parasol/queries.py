"""The queries of the routing and navigation operators: on the made-up city, whose requests, walks and fixes come
from the given tables, and, named shape_*, the same operator shapes on the given tables alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parasol.functions import chance, french, geo
from parasol.functions import shade as shading
from parasol.operators import graph, instructions, nearest, routing, sides, trace
from parasol.oracles import ORACLES as ORACLES
from parasol.plans.routes import Network, network, route
from parasol.sources import city
from parasol.sources import network as source
from parasol.sources.lineage import cut
from parasol.streaming import run, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _millis(name: str) -> Column:
    """Milliseconds since 1970 of a time without zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {name})")


def r3(c: Column | str, name: str | None = None) -> Column:
    """Rounded to millimetres: libraries of functions differ in the last bits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 3).alias(name) if name else F.round(c, 3)


def _segments(spark: SparkSession, exact: bool = False) -> DataFrame:
    return graph.measured(graph.last_segments(city.segments(spark)), exact)


def _net(spark: SparkSession) -> Network:
    cells = city.tiles(spark)
    part = F.split("id", "_")
    tile = cells.select(F.get(part, F.lit(0)).cast("int").alias("tx"), F.get(part, F.lit(1)).cast("int").alias("ty"), "id")
    s = city.segments(spark)
    first = geo.plane(F.get("geom", F.lit(0)).lon, F.get("geom", F.lit(0)).lat)
    s = s.withColumn("p", first).withColumn("tx", F.floor(F.col("p.x") / city.TILE_M).cast("int")).withColumn("ty", F.floor(F.col("p.y") / city.TILE_M).cast("int"))
    s = s.drop("tile").join(F.broadcast(tile), ["tx", "ty"]).withColumnRenamed("id", "tile").drop("tx", "ty", "p")
    return network(city.nodes(spark), s, city.crossings(spark), cells, city.TILE_M)


def _walk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Paths, their points, stages and traces. Points and stages are written once and read by all that follows: with
    what made them in every branch, a plan holds each join many times over, and the driver holds the plan."""
    path, segs = city.walks(spark, sf_dir), _segments(spark)
    points = cut(trace.stage_points(path, segs, graph.first_nodes(city.nodes(spark)), city.walk_ends(spark, sf_dir)))
    return path, points, cut(trace.stages(path, points, segs)), trace.traces(points)


def _places(traces: DataFrame) -> DataFrame:
    """Nine places along each trace, from a tenth to nine tenths."""
    k = F.explode(F.sequence(F.lit(1), F.lit(9))).alias("k")
    return traces.select("route_id", "longueur", k).select("route_id", "longueur", (F.col("longueur") * F.col("k") / 10).alias("s"))


def _shaded(spark: SparkSession, sf_dir: str, stages: DataFrame, at_departure: bool = True) -> DataFrame:
    start = stages.groupBy("route_id").agg(F.min("step").alias("start_step"))  # of the stages as written, not of walks made anew
    return cut(sides.with_shade(stages.join(trace.by_sorting(start), "route_id"), city.shade(spark), nearest.facing(_segments(spark)), at_departure))


# ---- sources and graph


@query
def project_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of each node, in Lambert-93."""
    n = graph.first_nodes(city.nodes(spark))
    return n.select("nid", "lon", "lat", r3("x", "x"), r3("y", "y"))


@query
def shade_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and bits of packed shade."""
    d = source.decoded(city.shade_documents(spark))
    return d.select("i", "j", "hhmm", F.col("val").cast("int").alias("val"), F.col("low_conf").cast("int").alias("low_conf"))


@query
def shade_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by step."""
    s = city.shade(spark).withColumn("classe", shading.label(F.col("val")))
    return s.groupBy("hhmm", "classe").agg(F.count(F.lit(1)).alias("n"), F.sum("low_conf").cast("long").alias("n_faible"))


@query
def edges_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge a pair, both ways."""
    e = graph.both_ways(graph.edges(city.segments(spark), city.crossings(spark)))
    return e.select("u", "v", "kind", F.round("l", 9).alias("l"), "i", "src")


@query
def segment_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last loaded of each number, with its length in metres; line items stand in for reloads."""
    again = _table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 264).cast("int").alias("i"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("int").alias("pos"))
    one = again.groupBy("i", "pos").agg(F.lit(1).alias("tile_ord"))
    s = city.segments(spark)
    loaded = s.where("i < 264").withColumn("tag", F.lit(-1)).unionByName(s.drop("tile_ord", "pos").join(one, "i").withColumn("tag", F.col("pos")))
    m = graph.measured(graph.last_segments(loaded))
    return m.select("i", "tag", r3(F.element_at("cumul", -1), "longueur"))


@query
def tile_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of each request."""
    q = city.requests(spark, sf_dir)
    p = q.select("route_id", geo.plane(F.col("dep_lon"), F.col("dep_lat")).alias("a"), geo.plane(F.col("arr_lon"), F.col("arr_lat")).alias("b"))
    boxes = p.select("route_id", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"))
    met = graph.tiles_in_reach(boxes, city.tiles(spark), city.TILE_M, 150.0)
    return met.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), F.min("tile").alias("premiere"), F.max("tile").alias("derniere"))


@query
def floored_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of requests, floored to the step."""
    q = city.requests(spark, sf_dir)
    return q.select("route_id", "heure", shading.floor_time(F.col("heure"), 15).alias("arrondie"))


@query
def sidewalk_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidewalks with shade at a time; the GeoJSON is read back."""
    layer = sides.sidewalk_layer(_segments(spark), city.shade(spark), "10:30")
    p = F.from_json("feature", "type string, geometry struct<type: string, coordinates: array<array<double>>>, properties struct<fraction_ombre: double, indetermine: boolean, confiance_faible: boolean>")
    rows = layer.select("i", p.alias("f"))
    return rows.select("i", "f.properties.fraction_ombre", "f.properties.indetermine", "f.properties.confiance_faible", F.size("f.geometry.coordinates").alias("n_points"))


# ---- joins by place


@query
def attach_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest sidewalk of every fix."""
    p = city.fixes(spark, sf_dir).select("event_id", geo.plane_exact(F.col("lon"), F.col("lat")).alias("m")).select("event_id", "m.x", "m.y")
    a = nearest.attach(p, nearest.strips(_segments(spark, exact=True)), "event_id")
    return a.select("event_id", "i", r3("projection_m", "projection_m"), r3("rest_m", "rest_m"), r3("distance_m", "distance_m"))


@query
def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches within the radius that the precision allows."""
    f = city.fixes(spark, sf_dir)
    reach = F.least(F.lit(25.0), F.greatest(F.lit(12.0), 2 * F.col("precision_m")))
    p = f.select("event_id", reach.alias("reach"), geo.plane(F.col("lon"), F.col("lat")).alias("m")).select("event_id", "reach", "m.x", "m.y")
    met = nearest.nearby(p, nearest.strips(_segments(spark)), 25.0).where("d <= reach")
    return met.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), r3(F.min("d"), "d_min"), r3(F.max("d"), "d_max"))


@query
def followed_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest street and nearest expected street among nine cells."""
    f = city.fixes(spark, sf_dir).select("event_id", geo.plane_exact(F.col("lon"), F.col("lat")).alias("m"))
    f = f.select("event_id", "m.x", "m.y", F.array(F.concat(F.lit("Rue H"), (F.col("event_id") % 6).cast("string"))).alias("expected"))
    got = nearest.followed_street(f, _segments(spark, exact=True), "event_id")
    return got.select("event_id", "i", "rue", "cote", r3("d", "d"), r3("d_expected", "d_expected"))


@query
def facing_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sidewalk opposite."""
    got = nearest.facing(_segments(spark))
    return got.select("i", "i_face", "cote_face", r3("distance_m", "distance_m"))


@query
def near_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments around a trace's box."""
    t = graph.first_nodes(city.nodes(spark)).where("nid < 3").select("x", "y")
    return nearest.within_reach(_segments(spark), t, 40.0).select("i", "rue")


# ---- costs and routes


@query
def edge_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of every edge at every step for two weights."""
    e = graph.edges(city.segments(spark), city.crossings(spark))
    rows = e.join(city.shade(spark).select("i", "j", "val"), "i", "left")
    sunny = F.coalesce(shading.sun(F.col("val"), F.col("kind")), F.lit(0.0))
    fixed = shading.crossing_cost(F.col("kind"), F.col("src"))
    cost = lambda k, f: F.round(shading.edge_cost(F.col("l"), sunny, fixed, F.lit(k), F.lit(f)), 6)
    return rows.select("lo", "hi", "j", cost(1.0, 1.0).alias("cout_1"), cost(4.0, 0.5).alias("cout_4"))


@query
def passage_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step at which a walker from each request's end passes each segment."""
    q = city.requests(spark, sf_dir).select("route_id", geo.plane(F.col("dep_lon"), F.col("dep_lat")).alias("p"))
    s = _segments(spark).select("i", ((F.get("line", F.lit(0)).x + F.element_at("line", -1).x) / 2).alias("mx"), ((F.get("line", F.lit(0)).y + F.element_at("line", -1).y) / 2).alias("my"))
    rows = q.join(F.broadcast(s))  # 288 rows
    # A slow clock, so that the small city spans several steps.
    d = geo.length(F.col("mx") - F.col("p.x"), F.col("my") - F.col("p.y")) * 40
    return rows.select("route_id", "i", shading.passage_step(F.lit(40), d, F.lit(city.STEPS)).alias("pas"))


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route(city.requests(spark, sf_dir), _net(spark), city.shade(spark).where("j is not null"))


@query
def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request's route under the detour cap, with its totals."""
    s = routing.summary(_routes(spark, sf_dir))
    return s.select(
        "route_id", "reachable", "k_effectif", "plafonne", r3("base_m", "base_m"), r3("distance_m", "distance_m"), r3("cout_pondere", "cout_pondere"),
        r3("distance_ombre_m", "distance_ombre_m"), r3("distance_soleil_m", "distance_soleil_m"), r3("distance_non_evaluee_m", "distance_non_evaluee_m"), F.col("nb_traversees").cast("long").alias("nb_traversees"),
    )


@query
def route_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of each route, back from its end."""
    p = routing.path_rows(_routes(spark, sf_dir))
    return p.select("route_id", "seq", "de", "vers", "kind", r3("l", "l"), "i", "src", "step", F.col("val").cast("int").alias("val"))


@query
def all_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O48 by joins alone: least costs from every corner."""
    e = graph.both_ways(graph.edges(city.segments(spark), city.crossings(spark)))
    links = e.select("u", "v", (F.col("l") + shading.crossing_cost(F.col("kind"), F.col("src"))).alias("cost"))
    sources = graph.first_nodes(city.nodes(spark)).select(F.col("nid").alias("source"))
    return routing.costs_by_relaxation(links, sources).select("source", "node", r3("cost", "cost"))


# ---- lines and instructions


@query
def stage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages by distance along the line."""
    *_, stages, _ = _walk(spark, sf_dir)
    return stages.select("route_id", "seq", r3("s0", "s0"), r3("s1", "s1"), "kind", "rue", "cote", "source", "i")


@query
def places_on_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position at tenths of each trace."""
    *_, traces = _walk(spark, sf_dir)
    p = _places(traces).join(traces.select("route_id", "pts"), "route_id")
    at = trace.place(F.col("pts"), F.col("s"))
    return p.select("route_id", r3("s", "s"), F.round(at.lon, 6).alias("lon"), F.round(at.lat, 6).alias("lat"))


@query
def headings_on_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading of the line at the same places."""
    *_, traces = _walk(spark, sf_dir)
    p = _places(traces).join(traces.select("route_id", "pts"), "route_id")
    return p.select("route_id", r3("s", "s"), F.round(trace.heading_at(F.col("pts"), F.col("s")), 3).alias("cap"))


@query
def planner_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions with shade."""
    got = instructions.planner(city.walks(spark, sf_dir), city.segments(spark), city.shade(spark).select("i", "j", "low_conf"))
    return got.select("route_id", "n", "type", "texte", "distance_m", "pct_ombre", "indetermine", "confiance_faible")


@query
def guidance_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions by distance along the line."""
    *_, stages, _ = _walk(spark, sf_dir)
    return instructions.guidance(stages).select("route_id", "n", "type", "texte", r3("s0", "s0"), r3("s1", "s1"), r3("longueur_m", "longueur_m"))


@query
def merged_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without short walks."""
    *_, stages, _ = _walk(spark, sf_dir)
    return instructions.without_short(instructions.guidance(stages)).select("route_id", "n", "type", "texte", r3("s0", "s0"), r3("s1", "s1"))


@query
def street_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets and turns."""
    *_, stages, traces = _walk(spark, sf_dir)
    got = instructions.streets(stages, traces)
    return got.select("route_id", "n", "rue", r3("s0", "s0"), r3("s1", "s1"), "manoeuvre", "direction", "rue_suivante", "traversee", "texte")


@query
def stage_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage at a place, and the sidewalk there, next or before."""
    *_, stages, traces = _walk(spark, sf_dir)
    got = instructions.stage_at(_places(traces).select("route_id", "s"), stages)
    return got.select("route_id", r3("s", "s"), "seq", "kind", "i", "rue", "cote")


@query
def instruction_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction at a place, what is left, and what is announced."""
    *_, stages, traces = _walk(spark, sf_dir)
    got = instructions.instruction_at(_places(traces).select("route_id", "s"), instructions.guidance(stages), traces)
    return got.select("route_id", r3("s", "s"), "n", "texte", r3("restant_dans_instruction_m", "reste"), "annonce", F.round("progression", 6).alias("progression"))


@query
def display_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown at places along each walk."""
    *_, stages, traces = _walk(spark, sf_dir)
    got = instructions.street_at(_places(traces).select("route_id", "s"), instructions.streets(stages, traces), traces)
    c = F.col
    return got.select(
        "route_id", r3("s", "s"), french.action(c("manoeuvre"), c("direction"), c("rue"), c("distance_m"), c("annonce")).alias("action"),
        french.detail(c("manoeuvre"), c("direction"), c("rue_suivante"), c("traversee"), c("annonce")).alias("detail"),
        french.metres(c("distance_m")).alias("distance"), geo.minutes_left(c("restant_total_m")).cast("long").alias("minutes"),
    )


# ---- shade and sides


@query
def shade_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of the street ahead."""
    *_, stages, traces = _walk(spark, sf_dir)
    got = sides.band(_places(traces), _shaded(spark, sf_dir, stages), 60.0)
    return got.select("route_id", r3("s", "s"), "seq", r3("d0", "d0"), r3("d1", "d1"), "kind", "o", "o_face", "known", "known_face")


@query
def shade_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean shade of both sides up to the next crossing."""
    *_, stages, traces = _walk(spark, sf_dir)
    got = sides.contrast(_places(traces), _shaded(spark, sf_dir, stages))
    return got.select("route_id", r3("s", "s"), r3("horizon", "horizon"), r3("ombre_suivi", "ombre_suivi"), r3("ombre_en_face", "ombre_en_face"), "actif")


@query
def contrast_after_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same beyond the next crossing."""
    *_, stages, traces = _walk(spark, sf_dir)
    got = sides.after_crossing(_places(traces), _shaded(spark, sf_dir, stages))
    return got.select("route_id", r3("s", "s"), r3("traversee_s0", "traversee_s0"), r3("distance_m", "distance_m"), r3("ombre_suivi", "ombre_suivi"), r3("ombre_en_face", "ombre_en_face"), "actif")


@query
def sun_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the sun lasts, and the sentence for it."""
    *_, stages, traces = _walk(spark, sf_dir)
    got = sides.reasons(_places(traces), _shaded(spark, sf_dir, stages))
    text = french.justification(F.col("soleil_m"), F.col("traversee_m"), F.col("ombre_apres_m"))
    return got.select("route_id", r3("s", "s"), r3("soleil_m", "soleil_m"), r3("traversee_m", "traversee_m"), r3("ombre_apres_m", "ombre_apres_m"), text.alias("texte"))


@query
def walking_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which side of the street to walk on."""
    *_, stages, traces = _walk(spark, sf_dir)
    segs = _segments(spark)
    got = sides.side_to_walk(_places(traces).select("route_id", "s"), stages, segs, nearest.facing(segs), traces)
    return got.select("route_id", r3("s", "s"), "cote", "methode", "cote_boussole", "rue")


@query
def street_shade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cent in shade of the side walked and of the street."""
    *_, stages, traces = _walk(spark, sf_dir)
    return sides.street_shares(sides.street_trace(_shaded(spark, sf_dir, stages, False), traces, _segments(spark)))


@query
def street_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and lines as drawn."""
    *_, stages, traces = _walk(spark, sf_dir)
    got = sides.street_trace(_shaded(spark, sf_dir, stages, False), traces, _segments(spark))
    return got.select("route_id", "seq", "classe", F.size("line").alias("n_points"))


# ---- scalar functions


@query
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns between headings."""
    e = _table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 37) % 1080 - 540).cast("double").alias("a"), ((F.col("event_id") * 101) % 1080 - 540).cast("double").alias("b"))
    return e.select("event_id", geo.heading_gap(F.col("a"), F.col("b")).alias("ecart"), geo.axis_gap(F.col("a"), F.col("b")).alias("axe"), geo.turn(F.col("a"), F.col("b")).alias("direction"))


@query
def local_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres around the first fix, back to degrees, and the view cone."""
    f = city.fixes(spark, sf_dir)
    m = geo.local_metres(F.col("lon"), F.col("lat"), F.lit(city.LON), F.lit(city.LAT))
    f = f.withColumn("m", m).withColumn("back", geo.local_degrees(F.col("m.x"), F.col("m.y"), F.lit(city.LON), F.lit(city.LAT)))
    c = geo.cone(F.col("lon"), F.col("lat"), (F.col("event_id") % 360).cast("double"))
    return f.select("event_id", r3("m.x", "x"), r3("m.y", "y"), F.round("back.lon", 9).alias("lon"), F.round("back.lat", 9).alias("lat"), F.size(c).alias("n_cone"))


@query
def random_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th draw of a seed, and a normal from two."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("graine"), (F.col("c_custkey") % 50 + 1).alias("k"))
    u, v = chance.draw(F.col("graine"), F.col("k")), chance.draw(F.col("graine"), F.col("k") + 1)
    return c.select("graine", "k", F.round(u, 12).alias("u"), F.round(chance.normal(u, v), 6).alias("normale"))


@query
def short_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as shown."""
    return _table(spark, sf_dir, "orders").select("o_orderkey", french.short_date(F.col("o_orderdate")).alias("date_courte"))


@query
def point_to_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from fixes to a bent segment, and its running length."""
    f = city.fixes(spark, sf_dir).select("event_id", geo.plane(F.col("lon"), F.col("lat")).alias("m"))
    s = F.broadcast(_segments(spark).where("i = 133").select("line", "cumul"))
    d = geo.polyline_distance(F.col("m.x"), F.col("m.y"), F.col("line"))
    return f.join(s).select("event_id", r3(d, "d"), r3(F.element_at("cumul", -1), "longueur"))


# ---- streams, as tables


def _simulated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Noisy simulated walks with a detour for every third, their traces and streets, and the sidewalks near all of them."""
    *_, stages, traces = _walk(spark, sf_dir)
    some = traces.select("route_id", "longueur")
    detours = some.where("route_id % 3 = 0").select("route_id", (F.col("longueur") * 0.6).alias("a_m"), F.lit(45.0).alias("longueur_m"), F.lit(90.0).alias("cap_relatif_deg"))
    fixes = trace.walked(traces, detours, noise_m=4.0, seed=F.col("route_id"))
    street = instructions.streets(stages, traces).withColumnRenamed("route_id", "walk_id")
    near = _segments(spark).select("i", "rue", "cote", "geom")  # 288 rows, near every walk
    return fixes, traces.withColumnRenamed("route_id", "walk_id"), street, near


def _guided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Simulated walks and their contexts."""
    fixes, *parts = _simulated(spark, sf_dir)
    return fixes, run.contexts(*parts)


def _navigated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Simulated walks as navigated, and their fixes."""
    fixes, traces, streets, near = _simulated(spark, sf_dir)
    return run.navigated(fixes, run.contexts(traces, streets), near), fixes


@query
def simulated_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions along traces, with detours."""
    fixes, _ = _guided(spark, sf_dir)
    return fixes.select("walk_id", "k", "t_ms", r3("s", "s"), "hors_trace", r3("ecart_m", "ecart_m"), "vitesse", "precision_m")


@query
def navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress, sidewalk, deviation and what follows, fix by fix."""
    got, _ = _navigated(spark, sf_dir)
    return got.select("walk_id", "t_ms", r3("s", "s"), r3("off_m", "off_m"), r3("confidence", "confidence"), "arrived", "snap_rue", "off_route", "out_now", r3("since_s", "since_s"), "reason", "street", "recalculate", "announce", "arrive")


@query
def recalculation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests from where walks left their route."""
    return run.recalculations(*_navigated(spark, sf_dir), city.requests(spark, sf_dir))


@query
def step_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps in made-up acceleration."""
    e = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("walk_id"), F.explode(F.sequence(F.lit(0), F.lit(249))).alias("k"))
    t = F.col("k") * 0.02
    rate = 1.5 + F.col("walk_id") % 5 * 0.2
    norm = 9.81 + 3.0 * F.sin(2 * 3.141592653589793 * rate * t) * F.when(F.col("walk_id") % 4 == 0, 0.1).otherwise(1.0)
    got = run.counted_steps(e.select("walk_id", norm.alias("norme"), t.alias("t")))
    return got.groupBy("walk_id").agg(F.max("steps").alias("pas"), r3(F.max("cadence"), "cadence"), F.sum(F.col("moving").cast("int")).alias("en_marche"))


@query
def compass_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed headings of orientation events."""
    e = _table(spark, sf_dir, "events")
    k = F.col("event_id")
    rows = e.select(
        F.col("user_id").alias("walk_id"), _millis("ts").alias("t_ms"), "event_id",
        F.when(k % 3 == 0, (k * 41 % 360).cast("double")).alias("webkitCompassHeading"), F.when(k % 3 == 1, (k * 29 % 360).cast("double")).alias("alpha"), (k % 2 == 0).alias("absolute"),
    )
    return run.headings(rows, "event_id").select("walk_id", "t_ms", r3("cap", "cap"), "emitted")


@query
def heading_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O66a, O66b on fixes of events, over six hours: heading from the oldest, mean value."""
    f = city.fixes(spark, sf_dir).withColumn("m", geo.plane(F.col("lon"), F.col("lat")))
    f = f.select("walk_id", "event_id", "t_ms", "m.x", "m.y", F.col("value").alias("off_m"))
    got = windows.mean_distance(windows.drift(f, seconds=21600), seconds=86400, least=3)
    return got.select("event_id", r3("deplacement_m", "deplacement_m"), r3("cap_reel", "cap_reel"), r3(F.col("moyenne") + 1e-7, "moyenne"))


@query
def steady_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O66c, O66d: all of a window beyond a threshold; how long a value has stood."""
    f = city.fixes(spark, sf_dir).withColumn("dev", F.col("value"))
    got = windows.displayed_for(windows.all_deviate(f, seconds=43200), "event_type")
    return got.select("event_id", "tous_devient", "depuis_ms")


@query
def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stop gap of O70: visits with gaps under six hours."""
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("walk_id"), "ts")
    return windows.stops(e, seconds=21600).select("walk_id", "debut", "fin", "n")


@query
def observation_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of an observation."""
    f = city.fixes(spark, sf_dir)
    p = F.greatest(F.lit(3.0), F.col("precision_m"))
    good, bad = 1.5 * p + 10, 4 * p + 25
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (bad - F.col("value")) / (bad - good)))
    return f.select("event_id", F.round(c, 9).alias("confiance"))


@query
def frozen_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fix that differs, and whether a fix comes after it."""
    f = city.fixes(spark, sf_dir)
    w = Window.partitionBy("walk_id").orderBy("t_ms", "event_id")
    step = F.floor(F.col("event_id") / 300)  # a receiver that repeats itself
    f = f.withColumn("here", step)
    moved = F.col("here") != F.first("here").over(w)
    return f.select("event_id", F.coalesce(F.max(moved).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)).alias("parti"))


@query
def completed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the drawn line that are behind, at places along each walk."""
    *_, stages, traces = _walk(spark, sf_dir)
    met = _places(traces).join(stages.select("route_id", "s1"), "route_id")
    return met.groupBy("route_id", r3("s", "s")).agg(F.sum((F.col("s1") <= F.col("s")).cast("int")).cast("long").alias("n_fait"))


@query
def walk_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals as JSON, read back."""
    e = _table(spark, sf_dir, "events")
    points = e.select(F.col("user_id").alias("walk_id"), _millis("ts").alias("t"), F.get_json_object("props", "$.k").cast("long").alias("k"), "event_id")
    events = e.where("event_type = 'purchase'").select(F.col("user_id").alias("walk_id"), _millis("ts").alias("t"), F.lit("achat").alias("type"))
    head = e.select(F.col("user_id").alias("walk_id")).distinct().withColumn("version", F.lit(1))
    j = source.journal(points, events, head)
    p = F.from_json("journal", "version int, points array<struct<t: bigint, k: bigint>>, evenements array<struct<t: bigint, type: string>>")
    rows = j.select("walk_id", p.alias("j"))
    return rows.select("walk_id", F.size("j.points").alias("n_points"), F.coalesce(F.when(F.size("j.evenements") >= 0, F.size("j.evenements")), F.lit(0)).alias("n_evenements"), F.aggregate("j.points", F.lit(0).cast("long"), lambda a, x: a + x.k).alias("somme_k"))


# ---- the same shapes on the given tables


@query
def shape_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape of O12: the last line of each part and supplier."""
    li = _table(spark, sf_dir, "lineitem")
    last = li.groupBy("l_partkey", "l_suppkey").agg(F.max_by(F.struct("l_quantity", "l_extendedprice"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice")).alias("x"))
    return last.select("l_partkey", "l_suppkey", "x.l_quantity", "x.l_extendedprice")


@query
def shape_anti_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape of O13: orders without lines, and orders with large ones."""
    o, li = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    none = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", F.lit("vide").alias("source"))
    large = o.join(li.where("l_quantity >= 50"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", F.lit("grande").alias("source"))
    return none.unionByName(large)


@query
def shape_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape of O53: runs of equal event types of a user."""
    e = _table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("new", (~F.lag("event_type").over(w).eqNullSafe(F.col("event_type"))).cast("int"))
    e = e.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query
def shape_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape of O40: the purchase before each event of a user."""
    e = _table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "purchase", F.struct("event_id", "value")), True).over(w)
    return e.withColumn("p", last).select("event_id", F.col("p.event_id").alias("achat"), F.col("p.value").alias("valeur"))


@query
def shape_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape of O52: conditional sums over lines."""
    li = _table(spark, sf_dir, "lineitem")
    late = F.col("l_linestatus") == "O"
    return li.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"),
        F.round(F.sum(F.when(late, F.col("l_extendedprice") * (1 - F.col("l_discount"))).otherwise(0.0)), 2).alias("ouvert"), F.count_if(late & (F.col("l_quantity") > 25)).alias("n_grandes"),
    )


@query
def shape_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape of O58: mean discount by price, null where under half is known."""
    li = _table(spark, sf_dir, "lineitem").withColumn("known", F.col("l_quantity") > 20)
    m = sides.mean_shade(F.col("l_extendedprice"), F.lit(True), F.col("known"), F.col("l_discount"))
    return li.groupBy("l_suppkey").agg(F.round(m, 9).alias("moyenne"))
