"""Angles in degrees, as columns. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap180(a: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(a + 180.0, F.lit(360.0)) - 180.0


def bearing(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def opposition(a: Column, b: Column) -> Column:
    """Smallest angle between two directions, 0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.when(d > 180.0, 360.0 - d).otherwise(d)


def face_error(heading: Column, dx: Column, dy: Column) -> Column:
    """Angle between a heading and the direction to a target at (dx, dy)."""
    return opposition(heading, bearing(dx, dy))


def circular_mean(a: Column) -> Column:
    """Aggregate: mean direction in (-180, 180]; null without values."""
    r = F.radians(a)
    return F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r))))


def circular_mean_360(a: Column) -> Column:
    """Aggregate: mean direction in [0, 360)."""
    m = F.pmod(circular_mean(a), F.lit(360.0))
    return F.when(m >= 360.0, 0.0).otherwise(m)
