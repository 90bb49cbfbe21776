import math

import pytest
from pyspark.sql import functions as F

from cohortcast.config import FIXTURE
from cohortcast.functions import densities as dens
from cohortcast.functions.spline import basis_value


def _grid(spark, name, loc, scale, lo=0.01, hi=120.0, n=24000):
    step = (hi - lo) / n
    df = spark.range(n).select((F.lit(lo) + F.col("id") * F.lit(step)).alias("x"))
    f = dens.density(name)(F.col("x"), F.lit(loc), F.lit(scale))
    return df.select("x", f.alias("d")).toPandas(), step


@pytest.mark.parametrize("name", ["gamma_density", "weibull_density", "hadwiger_density"])
def test_density_integrates_to_one(spark, name):
    pdf, step = _grid(spark, name, 22.0, 5.0)
    assert (pdf["d"].sum() * step) == pytest.approx(1.0, abs=2e-3)


def test_gamma_mode_at_location(spark):
    pdf, _ = _grid(spark, "gamma_density", 20.0, 4.0)
    assert pdf.loc[pdf["d"].idxmax(), "x"] == pytest.approx(20.0, abs=0.01)


def test_weibull_median_and_quartile(spark):
    pdf, step = _grid(spark, "weibull_density", 20.0, 4.0)
    cdf = pdf["d"].cumsum() * step
    med = pdf.loc[(cdf - 0.5).abs().idxmin(), "x"]
    q3 = pdf.loc[(cdf - 0.75).abs().idxmin(), "x"]
    assert med == pytest.approx(20.0, abs=0.05)
    assert q3 == pytest.approx(24.0, abs=0.05)


def test_hoisted_evaluation_equals_direct(spark):
    df = spark.createDataFrame([(21.5, 4.2, 17.5)], "loc double, s double, x double")
    for name in ["gamma_density", "weibull_density", "hadwiger_density"]:
        s1 = df.select("x", *dens.prepare(name, F.col("loc"), F.col("s"), "g"))
        s2 = s1.select("*", dens.finish(name, "g"))
        hoisted = s2.select(dens.evaluate(name, F.col("x"), "g")).collect()[0][0]
        direct = df.select(dens.density(name)(F.col("x"), F.col("loc"), F.col("s"))).collect()[0][0]
        assert hoisted == pytest.approx(direct, rel=1e-12)


def test_spline_rows_sum_to_one(spark):
    n = FIXTURE.n_ages_obs
    df = spark.range(1, n + 1).select(F.col("id").cast("double").alias("x"))
    cols = [basis_value(F.col("x"), F.lit(j), F.lit(1.0), F.lit(float(n))).alias(f"b{j}") for j in range(1, 9)]
    pdf = df.select(*cols).toPandas()
    assert (pdf.sum(axis=1) - 1.0).abs().max() < 1e-12


def test_dispersion_from_spline_basis(spark):
    from cohortcast.operators.likelihood import dispersion_from_basis

    basis = spark.createDataFrame([("A", 1, 1, 0.25), ("A", 1, 2, 0.75), ("A", 2, 1, 1.0), ("A", 2, 2, 0.0)],
                                  "Country string, Age_i int, k int, value double")
    beta = spark.createDataFrame([("A", 0, 1, 0.4), ("A", 0, 2, -0.8)], "Country string, Sim long, k int, beta double")
    got = {r["Age_i"]: r["Dispersion"] for r in dispersion_from_basis(basis, beta).collect()}
    assert got[1] == pytest.approx(1 + math.exp(0.25 * 0.4 - 0.75 * 0.8))
    assert got[2] == pytest.approx(1 + math.exp(0.4))


def test_dispersion_by_age_parses_index(spark):
    from cohortcast.operators.likelihood import dispersion_by_age

    long = spark.createDataFrame([("A", 1, "dispersion[1]", 3.0), ("A", 1, "dispersion[45]", 5.0), ("A", 1, "CEB[2]", 2.0)],
                                 "Country string, Sim long, param string, value double")
    got = {r["Age"]: r["Dispersion"] for r in dispersion_by_age(long, FIXTURE).collect()}
    assert got == {FIXTURE.first_data_age: 3.0, FIXTURE.last_data_age: 5.0}
