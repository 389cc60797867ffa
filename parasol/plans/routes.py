"""From requests to routes, lines, instructions: the operators put together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parasol.functions.geo import plane
from parasol.functions.shade import floor_time
from parasol.operators import graph, nearest, routing


@dataclass
class Network:
    """Tables of a network: nodes (nid, lon, lat, x, y), measured segments (with tile, ord), edges (lo, hi, kind, l, i, src, tile)."""

    nodes: DataFrame
    segments: DataFrame
    edges: DataFrame
    tiles: DataFrame  # id "tx_ty"
    tile_size: float = 1000.0
    step_minutes: int = 15


def network(nodes: DataFrame, segments: DataFrame, crossings: DataFrame, tiles: DataFrame, tile_size: float = 1000.0, step_minutes: int = 15) -> Network:
    """The network of loaded rows (see sources.network); a crossing's tile is that of its first node's segment."""
    n = graph.first_nodes(nodes)
    s = graph.measured(graph.last_segments(segments))
    e = graph.edges(segments, crossings)
    home = segments.select(F.explode(F.array("a", "b")).alias("lo"), "tile").groupBy("lo").agg(F.min("tile").alias("tile"))
    e = e.join(home, "lo", "left")
    return Network(n, s, e, tiles, tile_size, step_minutes)


def asked(requests: DataFrame, net: Network, shade: DataFrame) -> DataFrame:
    """Requests with region, attachments of both ends and step of departure, ready for the search.

    requests: route_id, dep_lon, dep_lat, arr_lon, arr_lat, heure, k, facteur, plafond, by_passage. All have
    the date of shade. A time that shade does not have is an error.
    """
    p = requests.withColumn("dep", plane(F.col("dep_lon"), F.col("dep_lat"))).withColumn("arr", plane(F.col("arr_lon"), F.col("arr_lat")))
    boxes = p.select("route_id", F.col("dep.x").alias("x0"), F.col("dep.y").alias("y0"), F.col("arr.x").alias("x1"), F.col("arr.y").alias("y1"))
    reach = graph.tiles_in_reach(boxes, net.tiles, net.tile_size).groupBy("route_id").agg(F.sort_array(F.collect_set("tile")).alias("tiles"))
    p = p.join(reach, "route_id").withColumn("region", F.array_join("tiles", ","))
    strips = nearest.strips(net.segments)
    ends = p.select("route_id", "tiles", F.explode(F.array(F.struct(F.lit("d").alias("end"), F.col("dep.x").alias("x"), F.col("dep.y").alias("y")), F.struct(F.lit("a").alias("end"), F.col("arr.x").alias("x"), F.col("arr.y").alias("y")))).alias("e"))
    ends = ends.select(F.struct("route_id", "e.end").alias("key"), "tiles", "e.x", "e.y")
    found = nearest.attach(ends, strips, "key", F.array_contains("tiles", F.col("tile")))
    side = lambda e: found.where(F.col("key.end") == e).select(
        F.col("key.route_id").alias("route_id"),
        *[F.col(c).alias(f"{e}_{n}") for c, n in (("i", "i"), ("a", "a"), ("b", "b"), ("projection_m", "proj"), ("rest_m", "rest"), ("px", "px"), ("py", "py"))],
    )
    times = shade.select("hhmm", "j").distinct()
    n_steps = times.agg(F.count(F.lit(1)).cast("int").alias("n_steps"))
    p = p.withColumn("heure", floor_time(F.col("heure"), net.step_minutes)).join(F.broadcast(times.withColumnRenamed("hhmm", "heure")), "heure", "left")
    missing = F.raise_error(F.concat(F.lit("pas de temps absent : "), F.col("heure"))).cast("int")
    p = p.withColumn("start_step", F.when(F.col("j").isNotNull(), F.col("j")).otherwise(missing)).join(F.broadcast(n_steps))
    return p.join(side("d"), "route_id").join(side("a"), "route_id").drop("dep", "arr", "tiles", "j")


def route(requests: DataFrame, net: Network, shade: DataFrame) -> DataFrame:
    """Routes of all requests (operators.routing.ROUTES), by shade of their date (i, j, hhmm, val)."""
    ready = asked(requests, net, shade)
    regions = ready.select("region").distinct().select("region", F.explode(F.split("region", ",")).alias("tile"))
    priced = routing.priced(net.edges, net.nodes, shade).join(regions, "tile")
    return routing.routes(ready, priced, net.step_minutes)
