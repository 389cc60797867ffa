"""The navigation loop: fixes in, guidance out, and new routes where walks need them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parasol.functions.geo import plane
from parasol.functions.shade import floor_time
from parasol.operators import graph, instructions, trace
from parasol.operators.routing import path_rows
from parasol.plans.routes import Network, route
from parasol.sources.lineage import cut
from parasol.streaming import run


def guidance(requests: DataFrame, net: Network, shade: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests -> stages, traces and walk contexts of their routes (walk_id is route_id).

    A walk's sidewalks are those of the tiles that its request reaches.
    """
    path = cut(path_rows(route(requests, net, shade).where("reachable")))  # searched once, read by all that follows
    point = lambda lon, lat: F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    ends = requests.select("route_id", point("dep_lon", "dep_lat").alias("dep"), point("arr_lon", "arr_lat").alias("arr"))
    points = cut(trace.stage_points(path, net.segments, net.nodes, ends))
    stages, traces = trace.stages(path, points, net.segments), trace.traces(points)
    streets = instructions.streets(stages, traces).withColumnRenamed("route_id", "walk_id")
    box = points.select("route_id", "lon", "lat")
    at = box.select("route_id", plane(F.col("lon"), F.col("lat")).alias("m")).groupBy(F.col("route_id").alias("walk_id")).agg(
        F.min("m.x").alias("x0"), F.min("m.y").alias("y0"), F.max("m.x").alias("x1"), F.max("m.y").alias("y1")
    )
    near = graph.tiles_in_reach(at, net.tiles, net.tile_size, 250.0).select("walk_id", "tile").join(net.segments.select("tile", "i", "rue", "cote", "geom"), "tile")
    return stages, traces, run.contexts(traces.withColumnRenamed("route_id", "walk_id"), streets, near)


def changed(requests: DataFrame, settings: DataFrame) -> DataFrame:
    """Requests with new weight or time where a walker has set one (route_id, k, heure, each null if left alone)."""
    new = settings.select("route_id", F.col("k").alias("_k"), F.col("heure").alias("_heure"))
    rows = requests.join(new, "route_id", "left")
    return rows.withColumns({"k": F.coalesce("_k", "k"), "heure": F.coalesce("_heure", "heure")}).drop("_k", "_heure")


def replanned(navigated: DataFrame, fixes: DataFrame, requests: DataFrame, net: Network, shade: DataFrame, clock: str | None = None) -> DataFrame:
    """Contexts of walks that left their route or went on after a stop, routed anew from where they are.

    The time is that of the request, or `clock` (HH:MM). Of several calls of one walk the last counts. A new
    context is a new trace, on which run.navigated and its stream start the walk anew.
    """
    again = run.recalculations(navigated, fixes, requests)
    last = again.groupBy("route_id").agg(F.max_by(F.struct(*[c for c in again.columns if c != "route_id"]), "t_ms").alias("r")).select("route_id", "r.*").drop("t_ms", "recalculate")
    if clock:
        last = last.withColumn("heure", floor_time(F.lit(clock), net.step_minutes))
    return guidance(cut(last), net, shade)[2]  # few rows, read by every join of the routing


def guided(fixes: DataFrame, requests: DataFrame, net: Network, shade: DataFrame, clock: str | None = None, context: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Whole walks with their new routes: (navigated, contexts), from the contexts of guidance(), made here if not given.

    Each round routes every walk anew from its first call not yet answered and goes through it again under the new
    trace, until no call is left; walks that called for nothing take no part. A call whose end cannot be reached is
    answered by no trace: the walk goes on along the old one.
    """
    context = guidance(requests, net, shade)[2] if context is None else context
    contexts = cut(context.withColumn("from_ms", F.lit(None).cast("long")))
    got = cut(run.navigated(fixes, contexts))
    answered = contexts.select("walk_id", F.lit(-1).cast("long").alias("until")).limit(0)
    done = None
    while True:
        open_ = got.where("recalculate is not null").join(answered, "walk_id", "left").where("until is null or t_ms > until")
        calls = cut(open_.groupBy("walk_id").agg(F.min("t_ms").alias("t_ms")))
        rest = got.join(calls.select("walk_id"), "walk_id", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        if calls.isEmpty():
            return done, contexts
        anew = replanned(got.join(calls, ["walk_id", "t_ms"], "left_semi"), fixes, requests, net, shade, clock).join(calls.withColumnRenamed("t_ms", "from_ms"), "walk_id")
        contexts = cut(contexts.unionByName(anew))
        answered = cut(answered.unionByName(calls.withColumnRenamed("t_ms", "until")).groupBy("walk_id").agg(F.max("until").alias("until")))
        called = calls.select("walk_id")
        got = cut(run.navigated(fixes.join(called, "walk_id", "left_semi"), contexts.join(called, "walk_id", "left_semi")))


def follow(fixes: DataFrame, context: DataFrame, out: str, checkpoint: str, on_recalculate: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Starts guidance of a stream of fixes; each micro-batch is appended to `out`, then its calls for a new route
    are handed over (for replanned())."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.write.mode("append").json(out)
        calls = batch.where("recalculate is not null")
        if on_recalculate and not calls.isEmpty():
            on_recalculate(calls, number)
        batch.unpersist()

    return run.navigated_stream(fixes, context).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, positions: DataFrame, every_ms: int = 1000, speed_up: float = 1.0) -> DataFrame:
    """Simulated positions (operators.trace.walked) as a stream in real time, `speed_up` times as fast, one step of
    every walk at each tick; at most a tick a millisecond."""
    ticks = 1000 / max(1.0, every_ms / speed_up)
    rate = spark.readStream.format("rate").option("rowsPerSecond", max(1, round(ticks))).load()
    return rate.select(F.col("value").cast("int").alias("k")).join(positions, "k").select("walk_id", "lon", "lat", "precision_m", "t_ms", "cap", "vitesse")
