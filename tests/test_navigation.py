"""The loop: route, walk off it, be called back, route anew."""

from pyspark.sql import functions as F

from parasol.operators import trace
from parasol.plans import navigation
from parasol.queries import _net
from parasol.sources import city
from parasol.streaming import run


def test_loop(spark, tmp_path):
    q = city.requests(spark, "/root/testdata/sf0.001").where("route_id in (4, 11)").withColumn("heure", F.lit("09:00"))
    net, shade = _net(spark), city.shade(spark)
    stages, traces, context = navigation.guidance(q, net, shade)
    context = context.cache()
    assert context.count() == traces.count() > 0 and stages.where("s1 < s0").count() == 0
    detour = traces.select("route_id", (F.col("longueur") / 2).alias("a_m"), F.lit(90.0).alias("longueur_m"), F.lit(90.0).alias("cap_relatif_deg"))
    fixes = trace.walked(traces, detour).select("walk_id", "lon", "lat", "precision_m", "t_ms", "cap", "vitesse").cache()
    got = run.navigated(fixes, context).cache()
    assert got.count() == fixes.count()
    calls = run.recalculations(got, fixes, q)
    assert calls.count() > 0
    first = got.where("recalculate is not null").agg(F.min_by(F.struct("walk_id", "t_ms"), "t_ms")).first()[0]
    one = fixes.where((F.col("walk_id") == first["walk_id"]) & (F.col("t_ms") <= first["t_ms"] + 5000)).cache()
    whole, contexts = navigation.guided(one, q.where(F.col("route_id") == first["walk_id"]), net, shade, "09:14", context.where(F.col("walk_id") == first["walk_id"]))
    rows = sorted(whole.collect(), key=lambda r: (r["walk_id"], r["t_ms"]))
    assert len(rows) == one.count() and contexts.count() == 2
    for a, b in zip(rows, rows[1:], strict=False):
        if a["walk_id"] == b["walk_id"] and a["recalculate"] and b["s"] < a["s"]:
            break  # on the new trace progress starts anew
    else:
        raise AssertionError("no walk was put on a new trace")
    fixes.coalesce(1).write.json(str(tmp_path / "in"))
    from parasol.sources import network

    seen = []
    s = network.stream(spark, str(tmp_path / "in"))
    navigation.follow(s, context, str(tmp_path / "out"), str(tmp_path / "ck"), lambda b, n: seen.append(b.count())).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == fixes.count() and sum(seen) == got.where("recalculate is not null").count()


def test_settings(spark):
    q = city.requests(spark, "/root/testdata/sf0.001").where("route_id < 3")
    new = spark.createDataFrame([(1, 4.0, None), (2, None, "12:00")], "route_id long, k double, heure string")
    rows = {r["route_id"]: r for r in navigation.changed(q, new).collect()}
    old = {r["route_id"]: r for r in q.collect()}
    assert rows[1]["k"] == 4.0 and rows[1]["heure"] == old[1]["heure"] and rows[2]["heure"] == "12:00" and rows[0] == old[0]


def test_replay_is_a_stream(spark):
    p = spark.createDataFrame([(1, 0, 2.0, 48.0, 5.0, 0, None, 0.0)], "walk_id long, k int, lon double, lat double, precision_m double, t_ms long, cap double, vitesse double")
    assert navigation.replay(spark, p, speed_up=20).isStreaming
