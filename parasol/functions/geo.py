"""Plane geometry, headings and map projections as Column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 ellipsoid and the Lambert-93 cone (parallels 44 and 49, origin 46.5 N 3 E, offsets in metres).
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101
PARALLELS, ORIGIN_LAT, ORIGIN_LON = (44.0, 49.0), 46.5, 3.0
OFFSET_X, OFFSET_Y = 700000.0, 6600000.0
# Radii of the spheres used for simulated steps and for the displayed position, metres a degree on screen.
STEP_RADIUS, SCREEN_RADIUS, SCREEN_DEGREE = 6378137.0, 6371008.8, 111320.0

ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))


def _isometric(lat: float) -> float:
    s = math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) * ((1 + ECCENTRICITY * s) / (1 - ECCENTRICITY * s)) ** (ECCENTRICITY / 2)


def _radius(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - (ECCENTRICITY * math.sin(lat)) ** 2)


_LOW, _HIGH = (math.radians(p) for p in PARALLELS)
CONE = math.log(_radius(_LOW) / _radius(_HIGH)) / math.log(_isometric(_LOW) / _isometric(_HIGH))
SCALE = SEMI_MAJOR * _radius(_LOW) / (CONE * _isometric(_LOW) ** CONE)
APEX = SCALE * _isometric(math.radians(ORIGIN_LAT)) ** CONE


def lambert93(lon: float, lat: float) -> tuple[float, float]:
    """Degrees to Lambert-93 metres, for Python steps; plane() is the same for columns."""
    rho = SCALE * _isometric(math.radians(lat)) ** CONE
    turn = CONE * math.radians(lon - ORIGIN_LON)
    return OFFSET_X + rho * math.sin(turn), OFFSET_Y + APEX - rho * math.cos(turn)


def let(value: Column, f) -> Column:
    """f(value) with value worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def plane(lon: Column, lat: Column) -> Column:
    """Degrees to a struct (x, y) of Lambert-93 metres."""
    phi = F.radians(lat)
    s = F.sin(phi) * ECCENTRICITY
    rho = SCALE * F.pow(F.tan(math.pi / 4 - phi / 2) * F.pow((1 + s) / (1 - s), F.lit(ECCENTRICITY / 2)), F.lit(CONE))
    turn = CONE * F.radians(lon - ORIGIN_LON)
    return F.struct((OFFSET_X + rho * F.sin(turn)).alias("x"), (OFFSET_Y + APEX - rho * F.cos(turn)).alias("y"))


def _exact(lon: pd.Series, lat: pd.Series) -> pd.DataFrame:
    at = [lambert93(x, y) if x is not None and y is not None and x == x and y == y else (None, None) for x, y in zip(lon.tolist(), lat.tolist(), strict=True)]
    return pd.DataFrame(at, columns=["x", "y"], dtype="float64")


def plane_exact(lon: Column, lat: Column) -> Column:
    """plane() by lambert93(): C's functions, whose last bits are those of SQL engines; Java's differ for one place in
    a hundred, and these bits decide between sidewalks that meet in the corner nearest to a point."""
    return F.pandas_udf(_exact, "x double, y double")(lon, lat)


def line_exact(geom: Column) -> Column:
    """The same for an array of (lon, lat)."""
    return F.udf(lambda line: None if line is None else [lambert93(p["lon"], p["lat"]) for p in line], "array<struct<x: double, y: double>>")(geom)


def length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def along(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Share of the way from a to b, between 0 and 1, at which p is nearest; 0 if a and b are one point."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, ((px - ax) * dx + (py - ay) * dy) / square).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def polyline_distance(px: Column, py: Column, line: Column) -> Column:
    """Distance from (px, py) to an array of points (x, y); null for fewer than two."""

    def to(k: Column) -> Column:
        a, b = F.get(line, k), F.get(line, k + 1)
        t = along(px, py, a.x, a.y, b.x, b.y)
        return length(px - (a.x + t * (b.x - a.x)), py - (a.y + t * (b.y - a.y)))

    return F.when(F.size(line) > 1, F.array_min(F.transform(F.sequence(F.lit(0), F.size(line) - 2), to)))


def cumulative(line: Column) -> Column:
    """Running length of an array of points (x, y), from 0."""
    start = F.array(F.lit(0.0))
    step = lambda acc, k: F.concat(
        acc, F.array(F.element_at(acc, -1) + length(F.get(line, k).x - F.get(line, k - 1).x, F.get(line, k).y - F.get(line, k - 1).y))
    )
    return F.when(F.size(line) > 1, F.aggregate(F.sequence(F.lit(1), F.size(line) - 1), start, step)).otherwise(start)


def heading_gap(a: Column, b: Column) -> Column:
    """Signed turn from heading a to b, in ]-180, 180]; `%` keeps the sign of what is divided."""
    d = (b - a) % 360
    return F.when(d > 180, d - 360).when(d <= -180, d + 360).otherwise(d)


def axis_gap(heading: Column, axis: Column) -> Column:
    """Angle between a heading and an axis walked either way, 0 to 90."""
    d = F.abs(heading_gap(heading, axis))
    return F.least(d, 180 - d)


def turn(before: Column, after: Column) -> Column:
    """Name of a change of heading: from 150 degrees on a U-turn, under 30 none."""
    d = (after - before + 540) % 360 - 180
    return (
        F.when(F.abs(d) >= 150, "demi-tour").when(F.abs(d) < 30, "tout droit").when(d > 0, "droite").otherwise("gauche")
    )


def heading(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Degrees from north, clockwise, between two near points in degrees."""
    dx = (lon1 - lon0) * F.cos(F.radians((lat0 + lat1) / 2))
    return F.degrees(F.atan2(dx, lat1 - lat0))


def local_metres(lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
    """Degrees to metres east and north of an origin."""
    k = math.radians(SCREEN_RADIUS)
    return F.struct(((lon - lon0) * k * F.cos(F.radians(lat0))).alias("x"), ((lat - lat0) * k).alias("y"))


def local_degrees(x: Column, y: Column, lon0: Column, lat0: Column) -> Column:
    k = math.radians(SCREEN_RADIUS)
    return F.struct((lon0 + x / (k * F.cos(F.radians(lat0)))).alias("lon"), (lat0 + y / k).alias("lat"))


def step_degrees(lat: Column) -> tuple[Column, Column]:
    """Degrees of longitude and latitude for a metre, as the walk simulator takes them."""
    one = 1 / math.radians(STEP_RADIUS)
    return one / F.cos(F.radians(lat)), F.lit(one)


def cone(lon: Column, lat: Column, toward: Column, reach: float = 60.0, half: int = 26) -> Column:
    """Polygon of a view cone: apex, an arc every 6 degrees, apex."""
    east, north = 1 / (SCREEN_DEGREE * F.cos(F.radians(lat))), 1 / SCREEN_DEGREE
    tip = F.array(F.struct(lon.alias("lon"), lat.alias("lat")))
    arc = F.transform(
        F.sequence(F.lit(-half), F.lit(half), F.lit(6)),
        lambda a: F.struct((lon + reach * F.sin(F.radians(toward + a)) * east).alias("lon"), (lat + reach * F.cos(F.radians(toward + a)) * north).alias("lat")),
    )
    return F.concat(tip, arc, tip)


def side_of(dx: Column, dy: Column, vx: Column, vy: Column, least: float = 0.2) -> Column:
    """Side on which v lies of direction d: null if nearly parallel."""
    p = dx * vy - dy * vx
    return F.when(F.abs(p) < least, None).when(p > 0, "gauche").otherwise("droite")


def half_up(x: Column) -> Column:
    """Nearest whole number, halves upwards also below zero."""
    return F.floor(x + 0.5)


def round_ten(x: Column) -> Column:
    """Metres as shown: tens, 10 at least."""
    return F.greatest(F.lit(10), half_up(x / 10) * 10)


def minutes_left(metres: Column, speed: float = 1.3) -> Column:
    return F.greatest(F.lit(1), half_up(metres / speed / 60))
