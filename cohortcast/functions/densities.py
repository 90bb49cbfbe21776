"""Parametric age densities of the two-component mixture (Column builders).

Each builder takes (x, location, scale) Columns and returns the density at x.
Location/scale conventions follow the model: gamma by (mode, sd), Weibull by
(median, upper quartile - median), Hadwiger by (mean, sd).  A location <= 0 gives
NaN (the logs are undefined there), never a silently dropped row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import NAN, lgamma, lit_d

DensityFn = Callable[[Column, Column, Column], Column]

_LN2 = math.log(2.0)
_LNPI = math.log(math.pi)


def gamma_params(loc: Column, scale: Column) -> tuple[Column, Column]:
    """(shape, rate) of a gamma with mode ``loc`` and sd-like ``scale``."""
    rate = (loc + F.sqrt(loc * loc + F.lit(4.0) * scale * scale)) / (F.lit(2.0) * scale * scale)
    shape = loc * rate + F.lit(1.0)
    return shape, rate


def gamma_density(x: Column, loc: Column, scale: Column) -> Column:
    shape, rate = gamma_params(loc, scale)
    logd = shape * F.log(rate) + (shape - F.lit(1.0)) * F.log(x) - rate * x - lgamma(shape)
    return F.exp(logd)


def weibull_params(loc: Column, scale: Column) -> tuple[Column, Column]:
    """(k, lambda) of a Weibull with median ``loc`` and upper quartile ``loc + scale``."""
    k = F.lit(_LN2) / (F.log(loc + scale) - F.log(loc))
    lam = loc / F.pow(F.lit(_LN2), F.lit(1.0) / k)
    return k, lam


def weibull_density(x: Column, loc: Column, scale: Column) -> Column:
    k, lam = weibull_params(loc, scale)
    z = x / lam
    dens = (k / lam) * F.pow(z, k - F.lit(1.0)) * F.exp(-F.pow(z, k))
    return F.when(loc <= 0, lit_d(NAN)).otherwise(dens)


def hadwiger_density(x: Column, loc: Column, scale: Column) -> Column:
    log_h = F.log(loc) - F.lit(0.5 * _LN2) - F.log(scale)
    part1 = log_h - F.log(loc) - F.lit(0.5 * _LNPI)
    part2 = F.lit(1.5) * F.log(loc) - F.lit(1.5) * F.log(x)
    h = F.exp(log_h)
    part3 = -(h * h) * (loc / x + x / loc - F.lit(2.0))
    return F.when(loc <= 0, lit_d(NAN)).otherwise(F.exp(part1 + part2 + part3))


# Density registry (name -> Column builder); users may register their own.
DENSITIES: dict[str, DensityFn] = {
    "gamma_density": gamma_density,
    "weibull_density": weibull_density,
    "hadwiger_density": hadwiger_density,
}


def register_density(name: str, fn: DensityFn) -> None:
    DENSITIES[name] = fn


def density(name: str) -> DensityFn:
    try:
        return DENSITIES[name]
    except KeyError:
        raise ValueError(f"unknown density {name!r}; known: {sorted(DENSITIES)}") from None


# --- hoisted evaluation ------------------------------------------------------
# Per-draw constants (shape/rate, lgamma(shape), Weibull k/lambda, Hadwiger H) are
# computed once per draw row *before* the age explode; only the x-dependent part
# is evaluated per (draw, age) row.  Catalyst does not hoist through Generate by
# itself, so the split is explicit.

def prepare(name: str, loc, scale, prefix: str) -> list:
    """Per-draw columns a, b, loc for density ``name`` (stage 1, from the location and
    scale); ``finish`` adds the constant c from them (stage 2).  Two projections keep
    the generated code small: Catalyst does not inline a non-cheap column that is
    referenced several times, so log-gamma sees a column, not an expression tree."""
    if name == "gamma_density":
        shape, rate = gamma_params(loc, scale)
        return [shape.alias(f"{prefix}_a"), rate.alias(f"{prefix}_b"), loc.alias(f"{prefix}_loc")]
    if name == "weibull_density":
        k, lam = weibull_params(loc, scale)
        return [k.alias(f"{prefix}_a"), lam.alias(f"{prefix}_b"), loc.alias(f"{prefix}_loc")]
    if name == "hadwiger_density":
        log_h = F.log(loc) - F.lit(0.5 * _LN2) - F.log(scale)
        part1 = log_h - F.log(loc) - F.lit(0.5 * _LNPI)
        h = F.exp(log_h)
        return [(part1 + F.lit(1.5) * F.log(loc)).alias(f"{prefix}_a"), (h * h).alias(f"{prefix}_b"),
                loc.alias(f"{prefix}_loc")]
    density(name)  # registered by the user: nothing to hoist but its arguments
    return [lit_d(0.0).alias(f"{prefix}_a"), scale.alias(f"{prefix}_b"), loc.alias(f"{prefix}_loc")]


def finish(name: str, prefix: str):
    """Stage-2 per-draw constant ``c`` from the stage-1 columns."""
    a, b = F.col(f"{prefix}_a"), F.col(f"{prefix}_b")
    if name == "gamma_density":
        return (a * F.log(b) - lgamma(a)).alias(f"{prefix}_c")
    if name == "weibull_density":
        return (a / b).alias(f"{prefix}_c")
    if name == "hadwiger_density":
        return F.lit(0.0).alias(f"{prefix}_c")
    density(name)
    return F.lit(0.0).alias(f"{prefix}_c")


def evaluate(name: str, x, prefix: str):
    """x-dependent part of density ``name`` given the columns from ``prepare``."""
    a, b, c, loc = (F.col(f"{prefix}_{s}") for s in ("a", "b", "c", "loc"))
    if name == "gamma_density":
        return F.exp(c + (a - F.lit(1.0)) * F.log(x) - b * x)
    if name == "weibull_density":
        z = x / b
        return F.when(loc <= 0, lit_d(NAN)).otherwise(c * F.pow(z, a - F.lit(1.0)) * F.exp(-F.pow(z, a)))
    if name == "hadwiger_density":
        return F.when(loc <= 0, lit_d(NAN)).otherwise(
            F.exp(a - F.lit(1.5) * F.log(x) - b * (loc / x + x / loc - F.lit(2.0)))
        )
    return density(name)(x, loc, b)


# --- dispatch on a column (I4 for several models in one job) -------------------
def _dispatch(name_col, builders: dict):
    expr = None
    for name, col in builders.items():
        expr = F.when(name_col == name, col) if expr is None else expr.when(name_col == name, col)
    return expr.otherwise(F.raise_error(F.concat(F.lit("unknown density: "), name_col)))


def prepare_by(name_col, loc, scale, prefix: str) -> list:
    """Stage-1 columns when the density name is a column (one job over several models)."""
    per = {n: prepare(n, loc, scale, prefix) for n in DENSITIES}
    out = []
    for i, suffix in enumerate(("a", "b")):
        out.append(_dispatch(name_col, {n: cols[i] for n, cols in per.items()}).alias(f"{prefix}_{suffix}"))
    out.append(loc.alias(f"{prefix}_loc"))
    return out


def finish_by(name_col, prefix: str):
    return _dispatch(name_col, {n: finish(n, prefix) for n in DENSITIES}).alias(f"{prefix}_c")


def evaluate_by(name_col, x, prefix: str):
    return _dispatch(name_col, {n: evaluate(n, x, prefix) for n in DENSITIES})
