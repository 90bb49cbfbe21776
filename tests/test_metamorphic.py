"""Metamorphic checks of SURVEY section 5."""

import pytest
from pyspark.sql import functions as F

from cohortcast.config import FIXTURE as C
from cohortcast.operators import comparators as cmp
from cohortcast.operators import folds
from cohortcast.operators import rates as rt


def _constant_rates(spark, rate=0.1):
    rows = [("A", y, a, y - a, 100.0 * rate, 100.0) for y in range(1995, 2002) for a in range(14, 51)]
    df = spark.createDataFrame(rows, "Country string, Year int, Age int, Cohort int, Births double, Exposure double")
    return rt.cell_rates(df)


def test_freeze_bias_zero_on_constant_data(spark):
    s = cmp.freeze_summary(cmp.freeze_forecast(_constant_rates(spark), C)).collect()[0]
    assert s["WBias_rate"] == pytest.approx(0.0, abs=1e-15)
    assert s["RMSE_births"] == pytest.approx(0.0, abs=1e-12)


def test_cfs_additive_over_age_split(spark):
    r = _constant_rates(spark, 0.05)
    whole = rt.completed_family_size(r).collect()
    lo = rt.completed_family_size(r.filter(F.col("Age") < 30)).withColumnRenamed("CFS", "a")
    hi = rt.completed_family_size(r.filter(F.col("Age") >= 30)).withColumnRenamed("CFS", "b")
    parts = {x["Cohort"]: x["a"] + x["b"] for x in lo.join(hi, ["Country", "Cohort"]).collect()}
    for w in whole:
        if w["Cohort"] in parts:
            assert w["CFS"] == pytest.approx(parts[w["Cohort"]], rel=1e-12)


def test_fold_search_deterministic_across_partitions(spark):
    pts = [("A", i + 1, (i * 7) % 23, (i * 5) % 17) for i in range(9)]
    df = spark.createDataFrame(pts, "Country string, i int, Time int, Age_i int")
    a = sorted(tuple(r) for r in folds.best_folds(df.repartition(1)).collect())
    b = sorted(tuple(r) for r in folds.best_folds(df.repartition(8)).collect())
    assert a == b


def test_sql_views_registered(spark):
    from cohortcast.sources.fixtures import register_views

    from .conftest import SF_SMALL

    register_views(spark, SF_SMALL)
    n = spark.sql("select count(*) from draws d join cells c on d.Country = c.Country and d.Cohort = c.Cohort "
                  "where c.Year = 1999").collect()[0][0]
    assert n > 0
