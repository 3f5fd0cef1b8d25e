"""Angles in degrees as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap360(a: Column) -> Column:
    """Into [0, 360).

    The full turn is added to every remainder, not to negative ones alone: what lacks the last bit of a full turn
    becomes 0, where it would be rounded to 360 later.
    """
    return (a % 360.0 + 360.0) % 360.0


def wrap180(a: Column) -> Column:
    """Into [-180, 180); what lacks the last bit of 180 becomes -180, as in :func:`wrap360`."""
    return wrap360(a + 180.0) - 180.0


def wrap180_closed(a: Column) -> Column:
    """Into [-180, 180]: both ends stay, as whole turns are taken off towards zero."""
    w = wrap180(a)
    return F.when((w == -180.0) & (a > 0), 180.0).otherwise(w)


def shortest_delta(a: Column, b: Column) -> Column:
    """From ``a`` to ``b`` the short way."""
    return wrap180(b - a)


def lerp(a: Column, b: Column, u: Column) -> Column:
    return a + (b - a) * u


def lerp_yaw(a: Column, b: Column, u: Column, full_turn: bool = False) -> Column:
    """Between yaws the short way, in [-180, 180) or [0, 360)."""
    return (wrap360 if full_turn else wrap180)(a + shortest_delta(a, b) * u)


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, as_col(low)), as_col(high))


def smoothstep(u: Column) -> Column:
    v = clamp(u, 0.0, 1.0)
    return v * v * (3.0 - 2.0 * v)


def smoothstep_slope(u: Column) -> Column:
    v = clamp(u, 0.0, 1.0)
    return 6.0 * v * (1.0 - v)


def ease_in(u: Column) -> Column:
    v = clamp(u, 0.0, 1.0)
    return v * v


def finite(x: Column) -> Column:
    """The number, or null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def viewpoint(x: Column, z: Column, yaw: Column) -> Column:
    """Angle from which a camera at the origin, looking along z, sees an actor at (x, z) with ``yaw``."""
    return wrap360(F.degrees(F.atan2(x, z)) - yaw)
