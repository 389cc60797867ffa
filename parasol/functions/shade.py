"""Readings of shade values: per cent in shade, 255 for undetermined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = 255
# Metres added for a crossing, walking speed in m/s.
MARKED_CROSSING, OTHER_CROSSING = 15.0, 30.0
WALKING = 1.3


def sun(value: Column, kind: Column | None = None) -> Column:
    """Share in the sun for costs: undetermined counts as shade, and so does all that is no sidewalk."""
    share = F.when(value == UNKNOWN, 0.0).otherwise(1 - value / 100)
    return share if kind is None else F.when(kind == "trottoir", share).otherwise(0.0)


def shade(value: Column) -> Column:
    """Share in shade, null if undetermined."""
    return F.when(value != UNKNOWN, value / 100)


def label(value: Column) -> Column:
    return F.when(value == UNKNOWN, "indetermine").when(value >= 50, "ombre").otherwise("soleil")


def shaded(share: Column) -> Column:
    """Undetermined counts as shaded."""
    return F.coalesce(share >= 0.5, F.lit(True))


def crossing_cost(kind: Column, source: Column) -> Column:
    marked = F.when(source == "osm_crossing", MARKED_CROSSING).otherwise(OTHER_CROSSING)
    return F.when(kind == "traversee", marked).otherwise(0.0)


def edge_cost(metres: Column, sunny: Column, fixed: Column, k: Column, factor: Column) -> Column:
    return metres * (1 + k * sunny) + factor * fixed


def floor_time(hhmm: Column, step: int) -> Column:
    """HH:MM with minutes floored to the step and hours as they are."""
    part = F.split(hhmm, ":")
    minute = F.floor(F.get(part, F.lit(1)).cast("int") / step) * step
    return F.concat(F.lpad(F.get(part, F.lit(0)).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"))


def passage_step(start: Column, metres: Column, n_steps: Column, step_minutes: int = 15) -> Column:
    """Step at which a walker is there: straight-line metres at walking speed, the last step at most."""
    later = F.floor(metres / WALKING / (60 * step_minutes)).cast("int")
    return F.least(start + later, n_steps - 1)
