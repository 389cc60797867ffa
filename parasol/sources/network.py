"""Readers for the tiled network and its shade measurements (JSON, explicit schemas), and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

# The fields of the exchange format.
MANIFEST = (
    "format_version INT, ville STRING, perimetre STRING, crs STRING, bbox_wgs84 ARRAY<DOUBLE>, taille_tuile_m DOUBLE, pas_minutes INT,"
    " n_segments INT, n_traversees INT, dates MAP<STRING, ARRAY<STRING>>,"
    " tuiles ARRAY<STRUCT<id: STRING, n_segments: INT, n_noeuds: INT, n_traversees: INT>>,"
    " conventions STRUCT<valeur_ombre: STRING, conf: STRING, doublons_arete: STRING>"
)
TILE = (
    "id STRING, noeuds ARRAY<ARRAY<DOUBLE>>,"
    " segments ARRAY<STRUCT<i: INT, a: BIGINT, b: BIGINT, l: DOUBLE, rue: STRING, cote: STRING, geom: ARRAY<ARRAY<DOUBLE>>>>,"
    " traversees ARRAY<STRUCT<a: BIGINT, b: BIGINT, l: DOUBLE, src: STRING>>"
)
SHADE = "date STRING, tuile STRING, pas ARRAY<STRING>, seg ARRAY<INT>, v STRING, conf STRING"
FIX = "walk_id BIGINT, lon DOUBLE, lat DOUBLE, precision_m DOUBLE, t_ms BIGINT, cap DOUBLE, vitesse DOUBLE"
ACCELERATION = "walk_id BIGINT, norme DOUBLE, t DOUBLE"
ORIENTATION = "walk_id BIGINT, t_ms BIGINT, webkitCompassHeading DOUBLE, alpha DOUBLE, absolute BOOLEAN"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def tiles(spark: SparkSession, path: str, ids: list[str] | DataFrame | None = None) -> DataFrame:
    """Tile documents of a folder, all or those of the given ids (a list, or a DataFrame with a column id).

    A tile's file bears its id, so of a list only the files named are opened; a DataFrame is joined after reading.
    """
    reader = spark.read.schema(TILE)
    if ids is None:
        return reader.json(path)
    if isinstance(ids, DataFrame):
        return reader.json(path).join(ids, "id", "left_semi")
    return _named(reader, ids).json(path).where(F.col("id").isin(ids))


def _named(reader: DataFrameReader, ids: list[str]) -> DataFrameReader:
    """Opens only the files of these ids; where there are none, no file."""
    return reader.option("pathGlobFilter", "{" + ",".join(f"{x}.json" for x in ids or ["-"]) + "}")


def nodes(tile: DataFrame, load: Column) -> DataFrame:
    """nid, lon, lat and load order (the tile's, then the place in it)."""
    at = tile.select(load.alias("tile_ord"), F.posexplode("noeuds").alias("pos", "n"))
    return at.select(F.get("n", F.lit(0)).cast("long").alias("nid"), F.get("n", F.lit(1)).alias("lon"), F.get("n", F.lit(2)).alias("lat"), "tile_ord", "pos")


def segments(tile: DataFrame, load: Column) -> DataFrame:
    at = tile.select(F.col("id").alias("tile"), load.alias("tile_ord"), F.posexplode("segments").alias("pos", "s"))
    line = F.transform("s.geom", lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    return at.select("s.i", "s.a", "s.b", "s.l", "s.rue", "s.cote", line.alias("geom"), "tile", "tile_ord", "pos")


def crossings(tile: DataFrame, load: Column) -> DataFrame:
    at = tile.select(load.alias("tile_ord"), F.posexplode("traversees").alias("pos", "t"))
    return at.select("t.a", "t.b", "t.l", "t.src", "tile_ord", "pos")


def shade_files(spark: SparkSession, path: str, dates: list[str] | None = None, ids: list[str] | None = None) -> DataFrame:
    """Shade documents of a folder with a subfolder for each date and in it a file for each tile.

    Of given dates and tile ids only the folders and files named are opened; a date that has no folder is an error.
    """
    reader = spark.read.schema(SHADE).option("recursiveFileLookup", True)
    if ids is not None:
        reader = _named(reader, ids)
    return reader.json(path if dates is None else [f"{path}/{d}" for d in dict.fromkeys(dates)])


def decoded(files: DataFrame) -> DataFrame:
    """Shade documents -> date, tile, i, j, hhmm, val (0..100 or 255), low_conf.

    Values are bytes by segment, then step; confidence is one bit each in the same order, high bits first,
    packed over the whole tile.
    """
    raw = files.select("date", F.col("tuile").alias("tile"), "pas", "seg", F.unbase64("v").alias("v"), F.unbase64("conf").alias("c"))
    row = raw.select("date", "tile", "pas", "v", "c", F.size("pas").alias("n"), F.posexplode("seg").alias("p", "i"))
    cell = row.select("date", "tile", "i", "v", "c", "p", "n", F.posexplode("pas").alias("j", "hhmm"))
    at = F.col("p") * F.col("n") + F.col("j")
    byte = lambda c, k: F.conv(F.hex(F.substring(F.col(c), k + 1, F.lit(1))), 16, 10).cast("smallint")
    bit = F.expr("getbit(conf_byte, 7 - (at % 8))").cast("tinyint")
    cell = cell.withColumn("at", at).withColumn("conf_byte", byte("c", F.floor(F.col("at") / 8).cast("int")))
    return cell.select("date", "tile", "i", "j", "hhmm", byte("v", F.col("at")).alias("val"), bit.alias("low_conf"))


def shade_on(shade: DataFrame, loaded: DataFrame, dates: DataFrame) -> DataFrame:
    """Shade of the loaded tiles on requested dates; a date that is not exported is an error."""
    known = shade.select("date").distinct().withColumn("known", F.lit(True))
    wanted = dates.select("date").distinct().join(known, "date", "left")
    unknown = F.concat(F.lit("date non exportee : "), F.col("date").cast("string"))
    checked = wanted.select(F.when(F.col("known"), F.col("date")).otherwise(F.raise_error(unknown)).alias("date"))
    return shade.join(loaded.select("tile").distinct(), "tile", "left_semi").join(F.broadcast(checked), "date")


def cleaned_fixes(raw: DataFrame) -> DataFrame:
    """Receiver rows with NaN headings and speeds as null."""
    no_nan = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return raw.select("walk_id", "lon", "lat", "precision_m", "t_ms", no_nan("cap"), no_nan("vitesse"))


def stream(spark: SparkSession, path: str, schema: str = FIX, per_trigger: int | None = None) -> DataFrame:
    """A folder of JSON rows as a stream."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.json(path)


def journal(points: DataFrame, events: DataFrame, head: DataFrame) -> DataFrame:
    """A walk's journal as one JSON document: its head, its points and its events, in order of time."""
    rows = lambda d, name: d.groupBy("walk_id").agg(F.sort_array(F.collect_list(F.struct("t", *[c for c in d.columns if c not in ("walk_id", "t")]))).alias(name))
    whole = head.join(rows(points, "points"), "walk_id", "left").join(rows(events, "evenements"), "walk_id", "left")
    return whole.select("walk_id", F.to_json(F.struct(*[c for c in whole.columns if c != "walk_id"])).alias("journal"))
