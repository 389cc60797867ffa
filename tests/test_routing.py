"""Rules of the graph that samples never show, and the two searches against each other."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from parasol.functions.shade import crossing_cost
from parasol.operators import graph, routing
from parasol.operators.instructions import street_groups
from parasol.plans.routes import route
from parasol.queries import _net
from parasol.sources import city, network


def test_edges(spark):
    s = spark.createDataFrame([(1, 10, 20, 5.0), (7, 20, 10, 6.0), (3, 10, 20, 7.0), (9, 30, 30, 1.0)], "i int, a long, b long, l double")
    c = spark.createDataFrame([(20, 10, 1.0, "carrefour", 0, 0), (10, 30, 8.0, "carrefour", 1, 0), (30, 10, 9.0, "osm_crossing", 0, 1)], "a long, b long, l double, src string, tile_ord int, pos int")
    got = {(r["lo"], r["hi"]): (r["kind"], r["l"], r["i"], r["src"]) for r in graph.edges(s, c).collect()}
    assert got == {(10, 20): ("trottoir", 6.0, 7, None), (30, 30): ("trottoir", 1.0, 9, None), (10, 30): ("traversee", 9.0, None, "osm_crossing")}
    assert graph.both_ways(graph.edges(s, c)).count() == 5


def test_ladder():
    assert routing.ladder(0) == [] and routing.ladder(-1) == []
    assert routing.ladder(0.2) == [0.2] and routing.ladder(1) == [1, 0.5, 0.25]


def test_search_equals_relaxation(spark):
    """At weight 0 a route costs what relaxation over the same edges and its ends costs."""
    q = city.requests(spark, "/root/testdata/sf0.001").where("route_id % 10 = 1").withColumn("k", F.lit(0.0))
    found = routing.summary(route(q, _net(spark), city.shade(spark))).select("route_id", "cout_pondere").collect()
    paths = routing.path_rows(route(q, _net(spark), city.shade(spark)))
    first = paths.where("de = -1").select("route_id", F.col("vers").alias("u"), F.col("l").alias("l0"))
    last = paths.where("vers = -2").select("route_id", F.col("de").alias("v"), F.col("l").alias("l1"))
    e = graph.both_ways(graph.edges(city.segments(spark), city.crossings(spark)))
    links = e.select("u", "v", (F.col("l") + crossing_cost(F.col("kind"), F.col("src"))).alias("cost"))
    least = routing.costs_by_relaxation(links, first.select(F.col("u").alias("source")).distinct())
    want = {r["route_id"]: r["c"] for r in first.join(last, "route_id").join(least, (F.col("source") == F.col("u")) & (F.col("node") == F.col("v"))).select("route_id", (F.col("l0") + F.col("l1") + F.col("cost")).alias("c")).collect()}
    assert want
    for r in found:
        if r["route_id"] in want:
            assert r["cout_pondere"] == pytest.approx(want[r["route_id"]], abs=1e-6)


def test_relaxation_that_is_cut_short_is_an_error(spark):
    links = spark.createDataFrame([(k, k + 1, 1.0) for k in range(4)], "u long, v long, cost double")
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        routing.costs_by_relaxation(links, spark.createDataFrame([(0,)], "source long"), rounds=2)


def test_missing_time_and_date_are_errors(spark):
    q = city.requests(spark, "/root/testdata/sf0.001").limit(1).withColumn("heure", F.lit("23:59"))
    with pytest.raises(Exception, match="pas de temps absent"):
        route(q, _net(spark), city.shade(spark)).collect()
    s = spark.createDataFrame([("2026-01-01", "t", 1)], "date string, tile string, i int")
    with pytest.raises(Exception, match="date non exportee"):
        network.shade_on(s, s, spark.createDataFrame([("2026-01-02",)], "date string")).collect()


def test_readers(spark, tmp_path):
    tile = {"id": "3_4", "noeuds": [[1, 2.0, 48.0], [2, 2.1, 48.0]], "segments": [{"i": 5, "a": 1, "b": 2, "l": 9.5, "rue": None, "cote": "nord", "geom": [[2.0, 48.0], [2.1, 48.0]]}], "traversees": []}
    (tmp_path / "3_4.json").write_text(json.dumps(tile))
    t = network.tiles(spark, str(tmp_path), ["3_4"])
    assert network.crossings(t, F.lit(0)).count() == 0
    assert network.nodes(t, F.lit(0)).count() == 2
    s = network.segments(t, F.lit(0)).first()
    assert s["rue"] is None and s["geom"][1]["lon"] == 2.1
    assert network.tiles(spark, str(tmp_path), ["9_9"]).count() == 0
    (tmp_path / "m").mkdir()
    (tmp_path / "m/manifest.json").write_text(json.dumps({"format_version": 1, "dates": {"2026-09-10": ["07:00"]}, "tuiles": [{"id": "3_4", "n_segments": 1}]}, indent=1))
    assert network.manifest(spark, str(tmp_path / "m")).first()["dates"] == {"2026-09-10": ["07:00"]}


def test_readers_open_only_what_is_asked_for(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"{k}_0.json").write_text(json.dumps({"id": f"{k}_0", "noeuds": [], "segments": [], "traversees": []}))
    few = network.tiles(spark, str(tmp_path), ["1_0", "3_0", "9_9"])
    assert {r["id"] for r in few.collect()} == {"1_0", "3_0"} and len(few.inputFiles()) == 2
    assert network.tiles(spark, str(tmp_path), []).count() == 0
    assert network.tiles(spark, str(tmp_path), spark.createDataFrame([("2_0",)], "id string")).count() == 1
    for date in ("2026-09-10", "2026-09-11"):
        (tmp_path / "shade" / date).mkdir(parents=True)
        for k in range(3):
            row = {"date": date, "tuile": f"{k}_0", "pas": ["07:00"], "seg": [7], "v": base64.b64encode(bytes([40 + k])).decode(), "conf": base64.b64encode(b"\x80").decode()}
            (tmp_path / "shade" / date / f"{k}_0.json").write_text(json.dumps(row))
    path = str(tmp_path / "shade")
    files = network.shade_files(spark, path, ["2026-09-11"], ["2_0"])
    assert len(files.inputFiles()) == 1 and network.shade_files(spark, path).count() == 6
    assert [(r["date"], r["tile"], r["val"], r["low_conf"]) for r in network.decoded(files).collect()] == [("2026-09-11", "2_0", 42, 1)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        network.shade_files(spark, path, ["2026-09-12"]).count()


def test_streets():
    stage = lambda kind, rue, s0, s1: {"kind": kind, "rue": rue, "s0": s0, "s1": s1}
    rows = [stage("liaison", None, 0, 2), stage("trottoir", "A", 2, 40), stage("traversee", None, 40, 50), stage("trottoir", "B", 50, 60), stage("trottoir", "A", 60, 90), stage("trottoir", None, 90, 95)]
    got = street_groups(rows)
    assert [(g["rue"], g["s0"], g["s1"]) for g in got] == [("A", 0, 95)]
    rows[3] = stage("trottoir", "B", 50, 80)
    assert [(g["rue"], g["s1"], g["cross"]) for g in street_groups(rows)[:2]] == [("A", 50, True), ("B", 80, False)]
