import math

import pytest
from pyspark.sql import functions as F

from parasol.functions import chance, french, geo, shade


@pytest.mark.parametrize("lon,lat,x,y", [(3, 46.5, 700000, 6600000), (2.36, 48.86, 653044.38308926, 6862408.64373077), (-2.1, 47.11, 313526.82413531, 6680233.73880161)])
def test_lambert93(spark, lon, lat, x, y):
    assert geo.lambert93(lon, lat) == pytest.approx((x, y), abs=1e-6)
    p = spark.range(1).select(geo.plane(F.lit(float(lon)), F.lit(float(lat))).alias("p")).first()["p"]
    assert (p["x"], p["y"]) == pytest.approx((x, y), abs=1e-6)


def test_draws(spark):
    k = spark.range(1, 4)
    one = [r[0] for r in k.select(chance.draw(F.lit(1), F.col("id"))).collect()]
    seven = [r[0] for r in k.select(chance.draw(F.lit(7), F.col("id"))).collect()]
    assert one == pytest.approx([0.6270739405881613, 0.002735721180215478, 0.5274470399599522], abs=1e-15)
    assert seven == pytest.approx([0.011704753153026104, 0.06195825757458806, 0.97690763277933], abs=1e-15)


def test_headings(spark):
    rows = [(350.0, 10.0, 20.0, 20.0, "tout droit"), (10.0, 350.0, -20.0, 20.0, "tout droit"), (0.0, 180.0, 180.0, 0.0, "demi-tour"), (0.0, 90.0, 90.0, 90.0, "droite"), (90.0, 0.0, -90.0, 90.0, "gauche")]
    for a, b, g, axis, name in rows:
        r = spark.range(1).select(geo.heading_gap(F.lit(a), F.lit(b)), geo.axis_gap(F.lit(a), F.lit(b)), geo.turn(F.lit(a), F.lit(b))).first()
        assert tuple(r) == (g, axis, name)


def test_shown_numbers(spark):
    r = spark.range(1).select(geo.round_ten(F.lit(3.0)), geo.round_ten(F.lit(25.0)), geo.minutes_left(F.lit(10.0)), geo.minutes_left(F.lit(156.0)), shade.floor_time(F.lit("9:44"), 15)).first()
    assert tuple(r) == (10, 30, 1, 2, "09:30")


def test_three_readings_of_undetermined(spark):
    r = spark.range(1).select(shade.sun(F.lit(255)), shade.shade(F.lit(255)), shade.label(F.lit(255)), shade.shaded(shade.shade(F.lit(255)))).first()
    assert tuple(r) == (0.0, None, "indetermine", True)


def test_sentences(spark):
    r = spark.range(1).select(
        french.justification(F.lit(42.0), F.lit(None).cast("double"), F.lit(0.0)), french.justification(F.lit(42.0), F.lit(61.0), F.lit(33.0)),
        french.street_label(F.lit(None).cast("string"), F.lit("nord")), french.short_date(F.lit("2026-09-10").cast("date")),
    ).first()
    assert tuple(r) == ("Côté soleil sur 40 m, jusqu'à l'arrivée", "Côté soleil sur 40 m, traversée dans 60 m, puis 30 m à l'ombre", "trottoir sans nom, cote nord", "10 sept.")


def test_polyline(spark):
    line = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (3, 4), (3, 4), (6, 4))])
    r = spark.range(1).select(geo.polyline_distance(F.lit(4.0), F.lit(6.0), line).alias("d"), geo.cumulative(line).alias("c")).first()
    assert r["d"] == pytest.approx(2.0) and r["c"] == [0.0, 5.0, 5.0, 8.0]
    assert math.isclose(geo.CONE, 0.7256077650532695) and math.isclose(geo.APEX, 6055612.049875985)
