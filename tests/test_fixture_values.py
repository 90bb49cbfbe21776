"""Checked values of FIXTURES.md section 3 (sf0.01)."""

import pytest
from pyspark.sql import functions as F

from cohortcast.config import FIXTURE as C
from cohortcast.operators import comparators as cmp
from cohortcast.plans.q_prep import emp_rates
from cohortcast.sources import fixtures as fx

from .conftest import SF_CHECK


def test_cells_totals(spark):
    r = fx.cells(spark, SF_CHECK).agg(
        F.count(F.lit(1)).alias("n"), F.sum("Births").alias("b"), F.sum("Exposure").alias("e"),
        F.countDistinct("Cohort").alias("nc"), F.min("Cohort").alias("c0"), F.max("Cohort").alias("c1"),
    ).collect()[0]
    assert (r["n"], r["b"], r["nc"], r["c0"], r["c1"]) == (1750, 60000.0, 56, 1940, 1995)
    assert r["e"] == pytest.approx(636651.254, abs=1e-3)


def test_draw_views(spark):
    d = fx.draws(spark, SF_CHECK, C).agg(F.count(F.lit(1)), F.sum("CEB"), F.max("Chain"), F.max("Iter")).collect()[0]
    assert d[0] == 50000 and d[1] == pytest.approx(110001.290197, abs=1e-3) and (d[2], d[3]) == (4, 50)
    s = fx.sampler_params(spark, SF_CHECK, C).agg(F.count(F.lit(1)), F.sum("divergent__"), F.sum("treedepth__")).collect()[0]
    assert tuple(s) == (1000, 10, 9000)


def test_freeze_rate_values(spark):
    out = {r["Country"]: r for r in cmp.freeze_summary(cmp.freeze_forecast(emp_rates(spark, SF_CHECK), C)).collect()}
    assert out["AFRICA"]["WBias_rate"] == pytest.approx(0.003634, abs=1e-6)
    assert out["AFRICA"]["RMSE_rate"] == pytest.approx(0.017773, abs=1e-6)
    assert out["MIDDLE EAST"]["WBias_rate"] == pytest.approx(-0.001087, abs=1e-6)


def test_log_score_total(spark):
    from cohortcast.plans.registry import all_queries

    df = all_queries()["log_score"].spark_df(spark, SF_CHECK)
    r = df.agg(F.count(F.lit(1)), F.sum("Score")).collect()[0]
    assert r[0] == 450
    assert r[1] == pytest.approx(-7989.753111, abs=1e-4)
