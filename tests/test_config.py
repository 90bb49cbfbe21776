"""Configurations from YAML files, overlaid by run specifications, and the axes of runs."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from cohortcast.config import FIXTURE, ConfigColumns
from cohortcast.operators import comparators, prep, rates
from cohortcast.plans import q_config
from cohortcast.sources import config_files as cf
from cohortcast.sources import fixtures as fx

from .conftest import SF_SMALL

TEXT = """---
# a comment
first_year: 1990   # another
country: "A # b: 'c'"
param_func:
  - gamma_density

  - 'weibull_density'
many: [1, "two", three ]
nothing:
also: ~
note: don't
last_data_age: 49
"""


def entries(spark, text):
    found = cf.yaml_entries(spark.createDataFrame([("x", text)], "name string, value string"))
    return {r.key: list(r["values"]) for r in found.collect()}


def test_yaml_entries(spark):
    assert entries(spark, TEXT) == {
        "first_year": ["1990"], "country": ["A # b: 'c'"], "param_func": ["gamma_density", "weibull_density"], "many": ["1", "two", "three"],
        "nothing": [], "also": [], "note": ["don't"], "last_data_age": ["49"]}
    assert entries(spark, TEXT.replace("\n", "\r\n"))["country"] == ["A # b: 'c'"]
    for odd in ("a: 1\n  b: 2", "a: {b: 1}", "a: |\n  text", "- 1", "just words"):
        with pytest.raises(Exception, match="not understood"):
            entries(spark, odd)


def test_files_become_typed_rows(spark, tmp_path):
    (tmp_path / "SWE.yaml").write_text("first_year: 1891\ncountry: Sweden\nother: 1\n")
    (tmp_path / "NEW LAND.yml").write_text("first_year: 1950\nlast_year: 2016\n")
    (tmp_path / "notes.txt").write_text("no yaml")
    rows = {r.name: r for r in cf.read_configs(spark, str(tmp_path), cf.COUNTRY_COLUMNS).collect()}
    assert set(rows) == {"SWE", "NEW LAND"}
    assert (rows["SWE"].first_year, rows["SWE"].country, rows["SWE"].last_year) == (1891, "Sweden", None)
    assert rows["NEW LAND"].last_year == 2016 and list(rows["SWE"].asDict()) == ["name", *cf.COUNTRY_COLUMNS]


def tables(spark):
    models = spark.createDataFrame([("base", "mixture", ["f", "g"], "variable", 6, 55, "Cohort", 2, 3), ("per", "mixture", ["f", "g"], "variable", 6, 55, "Period", 2, 3)],
                                   "name string, model string, param_func array<string>, dispersion string, minimum_age int, maximum_age int, time_dimension string, T_holdback int, T_forecast int")
    countries = spark.createDataFrame([("A", 1940, 2000, 1930, 8), ("B", 1990, 2001, 1980, 9)], "name string, first_year int, last_year int, first_full_cohort int, first_data_age int")
    return models, countries


def test_specs_replace_the_base(spark):
    specs = spark.createDataFrame([("A", "base", None, "h"), ("A", "per", "poisson", None), ("B", "per", None, None)],
                                  "Country string, base_config string, dispersion string, param_type_2 string")
    rows = {(r.Country, r.base_config): r for r in prep.run_config(specs, *tables(spark)).collect()}
    assert len(rows) == 3
    a, p, b = rows["A", "base"], rows["A", "per"], rows["B", "per"]
    assert (a.param_func, a.dispersion, a.start_time, a.T_insample, a.T_total) == (["f", "h"], "variable", 1930, 61, 64)
    assert (p.param_func, p.dispersion, p.start_time, p.T_insample) == (["f", "g"], "poisson", 1950, 49)
    assert (b.start_time, b.jump_off, b.T_insample, b.n_ages) == (1990, 1999, 10, 50)
    with pytest.raises(Exception, match="no configuration of none"):
        prep.run_config(spark.createDataFrame([("A", "none")], "Country string, base_config string"), *tables(spark)).collect()


def test_columns_equal_numbers(spark):
    """A table that gives every country the same settings yields what the numbers yield."""
    same = fx.countries(spark, SF_SMALL).select("Country", *[F.lit(getattr(FIXTURE, c)).alias(c) for c in (
        "first_year", "last_year", "first_full_cohort", "first_data_age", "last_data_age", "minimum_age", "maximum_age", "T_holdback", "time_dimension")],
        F.lit(FIXTURE.freeze_ages[0]).alias("first_freeze_age"), F.lit(FIXTURE.freeze_ages[1]).alias("last_freeze_age"))
    cfg, b, e = ConfigColumns(same), fx.births_table(spark, SF_SMALL, True), fx.exposure_table(spark, SF_SMALL, True)
    r = rates.cell_rates(fx.cells_checkpointed(spark, SF_SMALL))
    for build in (lambda c: prep.fit_window_obs(b, c), lambda c: prep.period_window_obs(b, c), lambda c: prep.exposure_grid(e, c),
                  lambda c: prep.period_exposure(e, c), lambda c: comparators.freeze_forecast(r, c)):
        one, other = build(FIXTURE), build(cfg)
        assert one.columns == other.columns and one.count() > 0
        assert one.exceptAll(other).count() == 0 == other.exceptAll(one).count()


def test_unknown_setting_and_axis(spark):
    cfg = ConfigColumns(spark.createDataFrame([("A", 1)], "Country string, T_holdback int"))
    with pytest.raises(AttributeError):
        cfg.last_year  # noqa: B018
    births = spark.createDataFrame([("A", 2000, 20, 1.0)], "Country string, Year int, Age int, Births double")
    with pytest.raises(ValueError, match="Cohort not present"):
        prep.fit_window_obs(births, FIXTURE)
    with pytest.raises(ValueError, match="must be 'Cohort' or 'Year'"):
        prep.assert_axis(births, "Time")


def test_shapes_hold_the_same_births(spark):
    t = fx.triangles(spark, SF_SMALL)
    sums = {r.lexis: (r.b, r.n) for r in q_config.shapes(spark, SF_SMALL).groupBy("lexis").agg(F.sum("Births").alias("b"), F.count("Cohort").alias("n")).collect()}
    total = t.agg(F.sum("Births")).first()[0]
    assert sums["VV"][0] == sums["RR"][0] == total and sums["RR"][1] == 0
    cells = {(r.Country, r.Year, r.Age): (r.Births, r.Exposure) for r in fx.cells(spark, SF_SMALL).collect()}
    for r in q_config.shapes(spark, SF_SMALL).filter("lexis = 'VV'").collect():
        b, x = cells.pop((r.Country, r.Year, r.Age))
        assert (b, round(x, 6)) == (r.Births, round(r.Exposure, 6))
    assert not cells


def test_other_queries_stay_without_what_llm_needs():
    code = ("import sys; sys.modules['xxhash'] = None; sys.modules['tokenizers'] = None; sys.modules['public_tokenizers'] = None; "
            "import __spark_entry__ as e; q = e.queries(); print(len(q), 'freeze_summary' in q, any(n.startswith('op1_') for n in q), len(e.oracle_sql()))")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 80 and out[1:3] == ["True", "False"] and int(out[3]) > 70
