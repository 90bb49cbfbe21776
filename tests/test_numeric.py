import math

import numpy as np

import pytest
from pyspark.sql import functions as F

from cohortcast.functions import numeric as nm
from cohortcast.operators.scoring import nb_cdf


def _one(spark, col):
    return spark.range(1).select(col.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize("x", [1e-3, 0.5, 1.0, 2.5, 7.0, 10.0, 33.3, 1e3, 1e6])
def test_lgamma_matches_math(spark, x):
    assert _one(spark, nm.lgamma(F.lit(x))) == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-11)


@pytest.mark.parametrize("n,d,expect", [(1.0, 2.0, 0.5), (1.0, 0.0, math.inf), (-1.0, 0.0, -math.inf)])
def test_ieee_div(spark, n, d, expect):
    assert _one(spark, nm.ieee_div(F.lit(n), F.lit(d))) == expect


def test_ieee_div_nan_and_null(spark):
    assert math.isnan(_one(spark, nm.ieee_div(F.lit(0.0), F.lit(0.0))))
    assert _one(spark, nm.ieee_div(F.lit(None).cast("double"), F.lit(1.0))) is None


def test_ln_rules(spark):
    assert _one(spark, nm.ln(F.lit(0.0))) == -math.inf
    assert math.isnan(_one(spark, nm.ln(F.lit(-1.0))))


def _nb_direct(y, mu, k):
    return (math.lgamma(y + k) - math.lgamma(k) - math.lgamma(y + 1) + k * math.log(k / (k + mu))
            + (y * math.log(mu / (k + mu)) if y else 0.0))


@pytest.mark.parametrize("y,mu,k", [(0, 2.5, 3.0), (7, 4.0, 1.5), (40, 35.2, 20.0), (3, 1e-6, 2.0)])
def test_nb_lpmf(spark, y, mu, k):
    assert _one(spark, nm.nb_lpmf(F.lit(float(y)), F.lit(mu), F.lit(k))) == pytest.approx(_nb_direct(y, mu, k), rel=1e-10)


def test_nb_mu_zero(spark):
    assert _one(spark, nm.nb_lpmf(F.lit(0.0), F.lit(0.0), F.lit(2.0))) == 0.0
    assert _one(spark, nm.nb_lpmf(F.lit(2.0), F.lit(0.0), F.lit(2.0))) == -math.inf


def test_nb_tends_to_poisson(spark):
    nb = _one(spark, nm.nb_lpmf(F.lit(5.0), F.lit(4.0), F.lit(1e7)))
    po = _one(spark, nm.poisson_lpmf(F.lit(5.0), F.lit(4.0)))
    assert nb == pytest.approx(po, abs=1e-5)


@pytest.mark.parametrize("y,mu,k", [(0, 3.0, 2.0), (5, 3.0, 2.0), (30, 12.0, 4.0)])
def test_nb_cdf_is_sum_of_pmf(spark, y, mu, k):
    direct = sum(math.exp(_nb_direct(j, mu, k)) for j in range(y + 1))
    assert _one(spark, nb_cdf(F.lit(y).cast("long"), F.lit(mu), F.lit(k))) == pytest.approx(direct, rel=1e-9)


def test_weighted_mean_drops_zero_weights(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("inf"), 0.0), (3.0, 2.0)], "x double, w double")
    assert df.agg(nm.r_weighted_mean(F.col("x"), F.col("w"))).collect()[0][0] == 2.0


def test_r_mean_na(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert df.agg(nm.r_mean(F.col("x"))).collect()[0][0] is None


@pytest.mark.parametrize("a,b", [(0.5, 0.5), (3.0, 40.0), (1e3, 2e3), (1e7, 1e7), (1e8, 5e7), (1e8, 1e8)])
def test_incomplete_beta_against_a_numerical_integral(a, b):
    """I_x(a, b) by the substitution x = 1 / (1 + e^-t), integrated with a fine grid around the peak."""
    from cohortcast.functions import special

    mean = a / (a + b)
    sd = math.sqrt(mean * (1 - mean) / (a + b + 1))
    for z in (-3.0, -0.5, 0.0, 1.0, 4.0):
        x = min(max(mean + z * sd, 1e-9), 1 - 1e-9)
        centre, wide = math.log(a / b), math.sqrt(1 / a + 1 / b)
        t = np.linspace(centre - 60 * wide, centre + 60 * wide, 1_200_001)
        log_p, log_q = -np.logaddexp(0, -t), -np.logaddexp(0, t)
        f = a * log_p + b * log_q
        f = np.exp(f - f.max())
        total = np.concatenate([[0.0], np.cumsum((f[1:] + f[:-1]) / 2)])
        want = np.interp(math.log(x / (1 - x)), t, total) / total[-1]
        assert special.betainc(a, b, x) == pytest.approx(want, abs=2e-6)


def test_incomplete_beta_never_returns_an_unconverged_value(monkeypatch):
    from cohortcast.functions import special

    monkeypatch.setattr(special, "_CONVERGED", -1.0)
    with pytest.raises(ArithmeticError):
        special.betainc(3.0, 4.0, 0.4)
