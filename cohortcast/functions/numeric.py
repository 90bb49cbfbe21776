"""Numeric Column helpers that keep R / IEEE semantics under Spark's ANSI mode.

Everything here builds JVM-side Column expressions (whole-stage codegen friendly);
no Python runs per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")

_LN_2PI_HALF = 0.5 * math.log(2.0 * math.pi)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def lit_d(x: float) -> Column:
    return F.lit(float(x)).cast("double")


def ieee_div(n, d) -> Column:
    """n / d with IEEE results instead of ANSI errors.

    Order: either NULL -> NULL; either NaN -> NaN; d != 0 -> n/d;
    n > 0 -> +inf; n < 0 -> -inf; else NaN.
    """
    n, d = _c(n).cast("double"), _c(d).cast("double")
    return (
        F.when(n.isNull() | d.isNull(), F.lit(None).cast("double"))
        .when(F.isnan(n) | F.isnan(d), lit_d(NAN))
        .when(d != 0, n / d)
        .when(n > 0, lit_d(INF))
        .when(n < 0, lit_d(-INF))
        .otherwise(lit_d(NAN))
    )


def ln(x) -> Column:
    """Natural log with R semantics: ln(0) = -inf, ln(x<0) = NaN, ln(NaN) = NaN."""
    x = _c(x).cast("double")
    return (
        F.when(x.isNull(), F.lit(None).cast("double"))
        .when(F.isnan(x), lit_d(NAN))
        .when(x == 0, lit_d(-INF))
        .when(x < 0, lit_d(NAN))
        .otherwise(F.log(x))
    )


def inv_logit(x) -> Column:
    x = _c(x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _stirling(z: Column) -> Column:
    # log-gamma by Stirling's series, accurate for z >= 7
    z2 = z * z
    series = (
        F.lit(1.0 / 12.0) / z
        - F.lit(1.0 / 360.0) / (z * z2)
        + F.lit(1.0 / 1260.0) / (z * z2 * z2)
        - F.lit(1.0 / 1680.0) / (z * z2 * z2 * z2)
        + F.lit(1.0 / 1188.0) / (z * z2 * z2 * z2 * z2)
    )
    return (z - F.lit(0.5)) * F.log(z) - z + F.lit(_LN_2PI_HALF) + series


def lgamma(x) -> Column:
    """log Gamma(x) for x > 0 as a Column expression (Spark has no lgamma).

    lgamma(x) = stirling(x + 7) - ln(x (x+1) ... (x+6)); abs error below 1e-12.
    """
    x = _c(x).cast("double")
    prod = x
    for k in range(1, 7):
        prod = prod * (x + F.lit(float(k)))
    shifted = _stirling(x + F.lit(7.0)) - F.log(prod)
    return (
        F.when(x.isNull(), F.lit(None).cast("double"))
        .when(x <= 0, lit_d(NAN))
        .when(x >= 1.0e7, _stirling(x))
        .otherwise(shifted)
    )


def with_lgamma(df: DataFrame, args: dict[str, Column]) -> DataFrame:
    """``df`` with ``lgamma`` of each of ``args`` as a column, in projections that refer to columns: the code of one log gamma
    over a longer argument, for many rows, grows beyond the 8,000 bytes up to which the JVM compiles a method."""
    x, z = {n: f"_x_{n}" for n in args}, {n: f"_z_{n}" for n in args}
    out = df.select("*", *[a.cast("double").alias(x[n]) for n, a in args.items()])
    out = out.select("*", *[(F.col(x[n]) + F.when(F.col(x[n]) >= 1.0e7, F.lit(0.0)).otherwise(F.lit(7.0))).alias(z[n]) for n in args])

    def of(n: str) -> Column:
        v = F.col(x[n])
        prod = v
        for k in range(1, 7):
            prod = prod * (v + F.lit(float(k)))
        near = F.when(v >= 1.0e7, F.lit(0.0)).otherwise(F.log(prod))
        return F.when(v.isNull(), F.lit(None).cast("double")).when(v <= 0, lit_d(NAN)).otherwise(_stirling(F.col(z[n])) - near)

    return out.select(*df.columns, *[of(n).alias(n) for n in args])


def nb_lpmf(y, mu, size, logs: tuple[Column, Column, Column] | None = None) -> Column:
    """Negative binomial (mean mu, size k) log pmf, R ``dnbinom(y, mu=, size=, log=TRUE)``.

    lg(y+k) - lg(k) - lg(y+1) + k ln(k/(k+mu)) + y ln(mu/(k+mu)); mu = 0 gives
    0 when y = 0 and -inf otherwise.  Pass column references (or cheap expressions):
    the log-gamma expansion repeats its argument.  ``logs`` has the log gammas of y + k, k and y + 1, where they are
    columns already."""
    y, mu, k = _c(y).cast("double"), _c(mu).cast("double"), _c(size).cast("double")
    of_sum, of_size, of_count = logs or (lgamma(y + k), lgamma(k), lgamma(y + F.lit(1.0)))
    core = (
        of_sum - of_size - of_count
        + k * F.log(k / (k + mu))
        + F.when(y == 0, F.lit(0.0)).otherwise(y * F.log(mu / (k + mu)))
    )
    return (
        F.when(mu.isNull() | y.isNull() | k.isNull(), F.lit(None).cast("double"))
        .when(mu == 0, F.when(y == 0, lit_d(0.0)).otherwise(lit_d(-INF)))
        .otherwise(core)
    )


def poisson_lpmf(y, mu) -> Column:
    """Poisson log pmf: y ln mu - mu - lgamma(y+1)."""
    y, mu = _c(y).cast("double"), _c(mu).cast("double")
    return (
        F.when(mu.isNull() | y.isNull(), F.lit(None).cast("double"))
        .when(mu == 0, F.when(y == 0, lit_d(0.0)).otherwise(lit_d(-INF)))
        .when(y == 0, -mu)
        .otherwise(y * F.log(mu) - mu - lgamma(y + F.lit(1.0)))
    )


def normal_lpdf(x, mu, sd) -> Column:
    """Normal log density with all constants."""
    x, mu, sd = _c(x), _c(mu), _c(sd)
    z = (x - mu) / sd
    return F.lit(-0.5) * z * z - F.log(sd) - F.lit(_LN_2PI_HALF)


def r_mean(x) -> Column:
    """R ``mean(x)`` without ``na.rm``: NULL as soon as one input is NULL."""
    x = _c(x)
    return F.when(F.count(x) < F.count(F.lit(1)), F.lit(None).cast("double")).otherwise(F.avg(x))


def r_weighted_mean(x, w) -> Column:
    """R ``weighted.mean(x, w)``: zero-weight terms are dropped before multiplying,
    NULL if a term with non-zero weight is NULL."""
    x, w = _c(x), _c(w)
    has_na = F.sum(F.when((w != 0) & x.isNull(), 1).otherwise(0)) > 0
    num = F.sum(F.when(w != 0, w * x))
    return F.when(has_na, F.lit(None).cast("double")).otherwise(ieee_div(num, F.sum(w)))


def hash_uniform(part: int, seed: int, *keys) -> Column:
    """Number in (0, 1) from a digest of the keys, the same under any partitioning, task retry or engine; ``part`` (0 or 1)
    chooses one of two independent numbers of the same keys."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(k).cast("string") for k in keys]))
    return (F.conv(F.substring(digest, 1 + 13 * part, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def hash_normal(seed: int, *keys) -> Column:
    """Standard normal from the two uniform numbers of the keys (Box-Muller)."""
    return F.sqrt(F.lit(-2.0) * F.log(hash_uniform(0, seed, *keys))) * F.cos(F.lit(2.0 * math.pi) * hash_uniform(1, seed, *keys))
