"""A made-up city of 12 by 12 corners, by arithmetic alone, for queries that need a network where none is given.

It has what real samples lack: segments between the same two nodes, crossings over segments, nodes in two tiles,
streets without a name, undetermined shade. Requests, walks and fixes come from the rows of the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 12
EAST, NORTH = 0.000136, 0.00009  # degrees between corners, about ten metres
LON, LAT = 2.35, 48.86
STEPS = 48
TILE_M = 100.0


def _corner(node: str) -> tuple:
    c = F.col(node)
    return LON + (c % SIDE) * EAST, LAT + F.floor(c / SIDE) * NORTH


def nodes(spark: SparkSession) -> DataFrame:
    """Every fifth node is loaded again, elsewhere, from a later tile."""
    rows = spark.range(SIDE * SIDE).withColumnRenamed("id", "nid")
    lon, lat = _corner("nid")
    first = rows.select("nid", lon.alias("lon"), lat.alias("lat"), F.lit(0).alias("tile_ord"), F.col("nid").cast("int").alias("pos"))
    again = first.where("nid % 5 = 0").select("nid", (F.col("lon") + 1).alias("lon"), "lat", F.lit(1).alias("tile_ord"), "pos")
    return first.unionByName(again)


def segments(spark: SparkSession) -> DataFrame:
    """Streets east-west, then north-south; every eleventh given again with a higher number, the other way round, longer, a hand's breadth off."""
    n = SIDE - 1
    across = spark.range(SIDE * n).select(
        F.col("id").cast("int").alias("i"), (F.floor(F.col("id") / n) * SIDE + F.col("id") % n).alias("a"), F.floor(F.col("id") / n).alias("line"), F.lit(1).alias("step"), F.lit("H").alias("way")
    )
    up = spark.range(SIDE * n).select(
        (F.col("id") + SIDE * n).cast("int").alias("i"), F.col("id").alias("a"), (F.col("id") % SIDE).alias("line"), F.lit(SIDE).alias("step"), F.lit("V").alias("way")
    )
    rows = across.unionByName(up).withColumn("b", F.col("a") + F.col("step"))
    pair = F.floor(F.col("line") / 2)
    nameless = F.when(F.col("way") == "H", pair == 3).otherwise(pair == 4)
    rows = rows.withColumn("rue", F.when(~nameless, F.concat(F.lit("Rue "), "way", pair.cast("string"))))
    even = F.col("line") % 2 == 0
    rows = rows.withColumn("cote", F.when(F.col("way") == "H", F.when(even, "sud").otherwise("nord")).otherwise(F.when(even, "ouest").otherwise("est")))
    rows = rows.withColumn("l", 10 + ((F.col("i") * 7919) % 997) / 997.0)
    (lon_a, lat_a), (lon_b, lat_b) = _corner("a"), _corner("b")
    bend = (F.col("i") % 3 - 1) * 1e-5
    mid_lon = (lon_a + lon_b) / 2 + F.when(F.col("way") == "V", bend).otherwise(0.0)
    mid_lat = (lat_a + lat_b) / 2 + F.when(F.col("way") == "H", bend).otherwise(0.0)
    point = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    rows = rows.withColumn("geom", F.array(point(lon_a, lat_a), point(mid_lon, mid_lat), point(lon_b, lat_b)))
    out = rows.select("i", "a", "b", "l", "rue", "cote", "geom", F.lit("all").alias("tile"), (F.col("i") % 3).alias("tile_ord"), F.col("i").alias("pos"))
    twice = out.where("i % 11 = 0").select((F.col("i") + 1000).alias("i"), F.col("b").alias("a"), F.col("a").alias("b"), (F.col("l") + 2).alias("l"), "rue", "cote", F.transform(F.reverse("geom"), lambda p: point(p.lon, p.lat + 2e-6)).alias("geom"), "tile", "tile_ord", (F.col("i") + 1000).alias("pos"))
    return out.unionByName(twice)


def crossings(spark: SparkSession) -> DataFrame:
    """Diagonals, every other one given again later and shorter, and some between nodes that a segment joins."""
    n = SIDE - 1
    cell = spark.range(n * n).select(F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("c")).withColumn("a", F.col("r") * SIDE + F.col("c"))
    kind = F.when((F.col("r") * F.col("c")) % 2 == 0, "osm_crossing").otherwise("carrefour")
    slant = cell.where("(r + c) % 3 = 0").select("a", (F.col("a") + SIDE + 1).alias("b"), (14 + ((F.col("a") * 31) % 97) / 97.0).alias("l"), kind.alias("src"), F.lit(0).alias("tile_ord"), F.col("a").cast("int").alias("pos"))
    later = slant.where("a % 2 = 0").select("a", "b", (F.col("l") - 5).alias("l"), F.lit("carrefour").alias("src"), F.lit(1).alias("tile_ord"), "pos")
    over = cell.where("r % 4 = 1").select("a", (F.col("a") + 1).alias("b"), F.lit(1.0).alias("l"), F.lit("osm_crossing").alias("src"), F.lit(0).alias("tile_ord"), (F.col("a") + 1000).cast("int").alias("pos"))
    return slant.unionByName(later).unionByName(over)


def shade(spark: SparkSession) -> DataFrame:
    """i, j, hhmm (from 07:00, every quarter of an hour), val, low_conf."""
    rows = segments(spark).select("i").crossJoin(F.broadcast(spark.range(STEPS).select(F.col("id").cast("int").alias("j"))))  # fixed sizes
    minute = 7 * 60 + 15 * F.col("j")
    hhmm = F.concat(F.lpad(F.floor(minute / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minute % 60).cast("string"), 2, "0"))
    value = F.when((F.col("i") + F.col("j")) % 23 == 0, 255).otherwise((17 * F.col("i") + 31 * F.col("j")) % 101)
    return rows.select("i", "j", hhmm.alias("hhmm"), value.cast("smallint").alias("val"), F.when((F.col("i") * F.col("j")) % 7 == 0, 1).otherwise(0).cast("tinyint").alias("low_conf"))


def shade_documents(spark: SparkSession) -> DataFrame:
    """The same shade, packed as in files: base64 of bytes, and of bits with the high ones first."""
    rows = shade(spark)
    bits = (SIDE * (SIDE - 1) * 2 + 24) * STEPS
    one = rows.groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "j", "hhmm", "val", "low_conf"))).alias("r"))
    hexes = F.array_join(F.transform("r", lambda x: F.lpad(F.hex(x.val.cast("int")), 2, "0")), "")
    marks = F.rpad(F.array_join(F.transform("r", lambda x: x.low_conf.cast("string")), ""), -(-bits // 8) * 8, "0")
    byte = F.transform(F.sequence(F.lit(0), F.floor(F.length("marks") / 8).cast("int") - 1), lambda k: F.lpad(F.conv(F.substring(F.col("marks"), k * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
    one = one.withColumn("marks", marks)
    return one.select(
        F.lit("2026-09-10").alias("date"), F.lit("all").alias("tuile"), F.array_sort(F.array_distinct(F.transform("r", lambda x: x.hhmm))).alias("pas"),
        F.array_sort(F.array_distinct(F.transform("r", lambda x: x.i))).alias("seg"), F.base64(F.unhex(hexes)).alias("v"), F.base64(F.unhex(F.array_join(byte, ""))).alias("conf"),
    )


def tiles(spark: SparkSession) -> DataFrame:
    """Cells of 100 metres around the city, as ids."""
    cells = spark.range(400).select((6522 + F.col("id") % 20).alias("x"), (68614 + F.floor(F.col("id") / 20)).alias("y"))
    return cells.select(F.concat(F.col("x").cast("string"), F.lit("_"), F.col("y").cast("string")).alias("id"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each customer."""
    k = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("route_id"))
    k = k.withColumn("d", (F.col("route_id") * 7) % (SIDE * SIDE)).withColumn("e", (F.col("route_id") * 13 + 5) % (SIDE * SIDE))
    (lon_d, lat_d), (lon_e, lat_e) = _corner("d"), _corner("e")
    east, north = (F.col("route_id") % 7 - 3.5) * 1e-5, (F.col("route_id") % 5 - 2.5) * 1e-5
    hhmm = F.concat((9 + F.col("route_id") % 8).cast("string"), F.lit(":"), (F.col("route_id") % 60).cast("string"))
    weight = F.element_at(F.array(*map(F.lit, (0.0, 1.0, 2.0, 4.0))), (F.col("route_id") % 4 + 1).cast("int"))
    return k.select(
        "route_id", (lon_d + east).alias("dep_lon"), (lat_d + north).alias("dep_lat"), (lon_e + north).alias("arr_lon"), (lat_e + east).alias("arr_lat"), hhmm.alias("heure"),
        weight.alias("k"), F.lit(1.0).alias("facteur"), F.lit(1.1).alias("plafond"), (F.col("route_id") % 2 == 0).alias("by_passage"),
    )


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for each customer, ends included: stairs to the north-east, every fifth step a diagonal crossing.

    Columns as in path rows: route_id, seq, de, vers, kind, l, i, src, step, val.
    """
    k = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("route_id"))
    k = k.withColumn("r0", F.col("route_id") % 4).withColumn("c0", (F.floor(F.col("route_id") / 4)) % 4).withColumn("n", (4 + F.col("route_id") % 5).cast("int"))
    rows = k.withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("n") + 1)))
    m = F.col("seq") - 1  # edges before this one
    # Steps go 2 east, 2 north, then a diagonal.
    part, whole = F.pmod(m, F.lit(5)), F.floor(m / 5)
    r = F.col("r0") + whole * 3 + F.when(part == 3, 1).when(part == 4, 2).otherwise(0)
    c = F.col("c0") + whole * 3 + F.when(part >= 2, 2).when(part == 1, 1).otherwise(0)
    inner = (F.col("seq") > 0) & (F.col("seq") <= F.col("n"))
    at = (r * SIDE + c).cast("long")
    rows = rows.withColumns({"at": at, "r": r, "c": c, "part": part, "inner": inner})
    to = F.when(F.col("part") < 2, F.col("at") + 1).when(F.col("part") < 4, F.col("at") + SIDE).otherwise(F.col("at") + SIDE + 1)
    start = F.col("r0") * SIDE + F.col("c0")
    cross = F.col("inner") & (F.col("part") == 4)
    i = F.when(F.col("part") < 2, F.col("r") * (SIDE - 1) + F.col("c")).otherwise(SIDE * (SIDE - 1) + F.col("at"))
    i = F.when(F.col("inner") & ~cross, i).cast("int")
    rows = rows.withColumns({"i": i, "to": to, "cross": cross, "step": (8 + F.col("route_id") % 30).cast("int")})
    l = F.when(F.col("cross"), 14.0).when(F.col("i").isNotNull(), 10 + ((F.col("i") * 7919) % 997) / 997.0).otherwise(1.5 + F.col("route_id") % 3)
    val = F.when((F.col("i") + F.col("step")) % 23 == 0, 255).otherwise((17 * F.col("i") + 31 * F.col("step")) % 101).cast("smallint")
    return rows.select(
        "route_id", "seq",
        F.when(F.col("seq") == 0, -1).otherwise(F.col("at")).cast("long").alias("de"),
        F.when(F.col("seq") == 0, start).when(F.col("seq") > F.col("n"), -2).otherwise(F.col("to")).cast("long").alias("vers"),
        F.when(F.col("cross"), "traversee").when(F.col("inner"), "trottoir").otherwise("attache").alias("kind"),
        l.alias("l"), "i", F.when(F.col("cross"), F.when(F.col("route_id") % 2 == 0, "osm_crossing").otherwise("carrefour")).alias("src"), "step",
        F.when(F.col("i").isNotNull(), val).alias("val"),
    )


def walk_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """route_id, dep and arr: a little off the first and last corners of walks()."""
    w = walks(spark, sf_dir).groupBy("route_id").agg(F.max(F.when(F.col("seq") == 0, F.col("vers"))).alias("first"), F.max_by(F.when(F.col("vers") == -2, F.col("de")), "seq").alias("last"))
    (lon_a, lat_a), (lon_b, lat_b) = _corner("first"), _corner("last")
    return w.select("route_id", F.struct((lon_a - 2e-5).alias("lon"), lat_a.alias("lat")).alias("dep"), F.struct((lon_b + 2e-5).alias("lon"), lat_b.alias("lat")).alias("arr"))


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position for each event, somewhere in the city."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    x, y = (F.col("event_id") * 37) % 1201, (F.col("event_id") * 53) % 1103
    return e.select(
        F.col("user_id").alias("walk_id"), "event_id", (LON + x * (EAST * 11 / 1200)).alias("lon"), (LAT + y * (NORTH * 11 / 1100)).alias("lat"),
        (3 + F.col("event_id") % 12).cast("double").alias("precision_m"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("t_ms"), F.col("ts"), "value", "event_type",
    )
