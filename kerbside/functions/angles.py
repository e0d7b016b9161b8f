"""Angles in degrees, counter-clockwise from east, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Turns by heading change in degrees, each from its lower bound (included) to its upper bound (excluded).
TURNS = ((-180.0, -135.0, "uturn"), (-135.0, -35.0, "right"), (-35.0, 35.0, "straight"), (35.0, 135.0, "left"), (135.0, 180.0, "uturn"))


def wrap(degrees: Column) -> Column:
    """The angle in [-180, 180)."""
    return degrees - 360.0 * F.floor((degrees + 180.0) / 360.0)


def difference(a: Column, b: Column) -> Column:
    """Signed angle from b to a in [-180, 180)."""
    return wrap(a - b)


def bearing(dx: Column, dy: Column) -> Column:
    """Direction of (dx, dy)."""
    return F.degrees(F.atan2(dy, dx))


def to_compass(degrees: Column) -> Column:
    """Clockwise from north, in [0, 360)."""
    return F.pmod(90.0 - degrees + 360.0, F.lit(360.0))


def turn_label(before: Column, after: Column) -> Column:
    """Kind of turn from one bearing to the next, left being positive; `unknown` where a bearing is null."""
    delta = difference(after, before)
    out = F.lit("straight")
    for low, high, name in TURNS:
        out = F.when((delta >= low) & (delta < high), F.lit(name)).otherwise(out)
    return F.when(before.isNull() | after.isNull(), F.lit("unknown")).otherwise(out)


def circular_mean(degrees: Column) -> Column:
    """Aggregate: direction of the sum of unit vectors."""
    return F.degrees(F.atan2(F.sum(F.sin(F.radians(degrees))), F.sum(F.cos(F.radians(degrees)))))
