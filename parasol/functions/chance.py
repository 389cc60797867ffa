"""Seeded random numbers whose k-th draw is a function of k, so that rows can be drawn in any order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The generator's increment and masks.
INCREMENT, MASK = 0x6D2B79F5, 0xFFFFFFFF


def _times(a: Column, b: Column) -> Column:
    """Product modulo 2^32 of values below 2^32, without a wider type: the high half is taken alone."""
    low = F.lit(0xFFFF)
    high = F.shiftright(a, 16) * b % (1 << 16)
    return (a.bitwiseAND(low) * b + high * (1 << 16)).bitwiseAND(F.lit(MASK))


def draw(seed: Column, k: Column) -> Column:
    """The k-th number (from 1) in [0, 1) of the 32-bit generator that starts at seed."""
    state = (seed.cast("long").bitwiseAND(F.lit(MASK)) + k.cast("long") * INCREMENT).bitwiseAND(F.lit(MASK))
    t = _times(state.bitwiseXOR(F.shiftright(state, 15)), state.bitwiseOR(F.lit(1)))
    mixed = (t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(MASK))
    t = mixed.bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftright(t, 14)) / float(1 << 32)


def normal(u: Column, v: Column) -> Column:
    """A standard normal from two uniform draws; null if one is 0, where the sequence would draw again."""
    return F.when((u > 0) & (v > 0), F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v))
