"""Heights along an axis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def height(knots: list[tuple[float, float]], s: Column, curve: float = 0.0) -> Column:
    """Height at s of straight grades between knots (s, z); with `curve` metres of parabola around each inner knot."""
    out = F.when(s <= knots[0][0], F.lit(knots[0][1]))
    for (s0, z0), (s1, z1) in zip(knots[:-1], knots[1:], strict=True):
        out = out.when(s <= s1, z0 + (s - s0) * ((z1 - z0) / (s1 - s0)))
    z = out.otherwise(F.lit(knots[-1][1]))
    for (s0, z0), (s1, z1), (s2, z2) in zip(knots[:-2], knots[1:-1], knots[2:], strict=True) if curve else []:
        g0, g1, h = (z1 - z0) / (s1 - s0), (z2 - z1) / (s2 - s1), curve / 2
        x = s - (s1 - h)
        z = F.when(F.abs(s - s1) < h, z1 - g0 * h + g0 * x + (g1 - g0) / (2 * curve) * x * x).otherwise(z)
    return z


def ramp(length: float, top: float, s: Column) -> Column:
    """A straight fall from top to the ground over a length, 0 after it."""
    return F.greatest(F.lit(0.0), top * (1 - F.least(F.greatest(s, F.lit(0.0)), F.lit(length)) / length))
