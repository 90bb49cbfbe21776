"""Uniform cubic B-spline basis as Column expressions (dispersion basis)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cubic_bspline(u: Column) -> Column:
    """Uniform cubic B-spline with support [0, 4) evaluated at ``u``."""
    u2 = u * u
    u3 = u2 * u
    return (
        F.when((u >= 0) & (u < 1), u3 / 6.0)
        .when((u >= 1) & (u < 2), (F.lit(-3.0) * u3 + F.lit(12.0) * u2 - F.lit(12.0) * u + F.lit(4.0)) / 6.0)
        .when((u >= 2) & (u < 3), (F.lit(3.0) * u3 - F.lit(24.0) * u2 + F.lit(60.0) * u - F.lit(44.0)) / 6.0)
        .when((u >= 3) & (u < 4), F.pow(F.lit(4.0) - u, 3) / 6.0)
        .otherwise(F.lit(0.0))
    )


def basis_value(x: Column, j: Column, x_min: Column, x_max: Column, n_interior: int = 6) -> Column:
    """Value of raw basis column ``j`` (1-based) at ``x`` for equally spaced knots:
    gap = (max - min) / (n_interior - 1), knots start at min - 3 gap, basis j starts at knot j."""
    gap = (x_max - x_min) / F.lit(float(n_interior - 1))
    knot_j = x_min - F.lit(3.0) * gap + (j - F.lit(1)) * gap
    return cubic_bspline((x - knot_j) / gap)
