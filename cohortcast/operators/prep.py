"""Model-input preparation.

The reference builds one in-memory list per (country, model) run; here every
table is long and keyed by Country, so all countries are prepared in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import PARAM_TYPES, CohortConfig, Windows
from ..functions.spline import basis_value
from .rates import births_clamped


def assert_axis(df: DataFrame, axis: str) -> None:
    """The time axis must exist in the data."""
    if axis not in ("Cohort", "Year"):
        raise ValueError("Time dimension must be 'Cohort' or 'Year' (period)")
    if axis not in df.columns:
        raise ValueError(f"{axis} not present in data frame; conflict with specified configuration")


def fit_window_obs(births: DataFrame, cfg: Windows) -> DataFrame:
    """Cohort-axis model observations.

    Order as in the reference (quirk X21): clamp age, sum, derive Year from the
    clamped age, then filter to the fit window."""
    assert_axis(births, "Cohort")
    b = births_clamped(cfg.attach(births), "Cohort", cfg.first_data_age, cfg.last_data_age)
    b = (
        cfg.attach(b).withColumn("Age_i", F.col("Age") - F.lit(cfg.first_data_age - 1))
        .withColumn("Year", F.col("Cohort") + F.col("Age"))
        .filter((F.col("Cohort") >= cfg.first_full_cohort) & (F.col("Year") <= cfg.last_year - cfg.T_holdback))
    )
    w = Window.partitionBy("Country")
    return b.select(
        "Country",
        "Cohort",
        "Age",
        "Age_i",
        "Year",
        (F.col("Cohort") - F.min("Cohort").over(w) + F.lit(1)).alias("Time"),
        F.bround(F.col("Births")).cast("long").alias("births"),
    )


def period_window_obs(births: DataFrame, cfg: Windows) -> DataFrame:
    """Period-axis observations (B5, B6): Year in [max(first_year, 1950), last_year - T_holdback]
    (quirk X1/X2: the intended semantics, with ``first_year``)."""
    assert_axis(births, "Year")
    b = cfg.attach(births_clamped(cfg.attach(births), "Year", cfg.first_data_age, cfg.last_data_age))
    b = b.filter((F.col("Year") >= cfg.first_period) & (F.col("Year") <= cfg.jump_off))
    w = Window.partitionBy("Country")
    return b.select(
        "Country",
        "Year",
        "Age",
        (F.col("Age") - F.lit(cfg.first_data_age - 1)).alias("Age_i"),
        (F.col("Year") - F.min("Year").over(w) + F.lit(1)).alias("Time"),
        F.bround(F.col("Births")).cast("long").alias("births"),
    )


def axis_window_obs(shapes: DataFrame, cfg: Windows) -> DataFrame:
    """A3 + B1 + B4 + B5: observations of cohort and period runs in one table, each on its own axis.

    ``shapes`` has both Lexis shapes (``rates.lexis_shapes``); a cohort run takes the parallelograms (``VV``) by cohort, a
    period run the squares (``RR``) by year.  Ages are clamped and summed first (quirk X21); the window begins at the
    run's start and ends with its jump-off year."""
    def axis():
        cohort = F.lit(cfg.time_dimension) == "Cohort"
        return cohort, F.when(cohort, F.lit("VV")).otherwise(F.lit("RR"))

    s = cfg.attach(shapes)
    cohort, lexis = axis()
    s = s.filter(F.col("lexis") == lexis).withColumn("axis_time", F.when(cohort, F.col("Cohort")).otherwise(F.col("Year")))
    b = cfg.attach(births_clamped(s, "axis_time", cfg.first_data_age, cfg.last_data_age))
    cohort, lexis = axis()
    at = F.col("axis_time")
    year = F.when(cohort, at + F.col("Age")).otherwise(at)
    b = b.filter((at >= cfg.start_time) & (year <= cfg.jump_off))
    return b.select(
        "Country", lexis.alias("lexis"), at.alias("Axis_time"), "Age", (F.col("Age") - F.lit(cfg.first_data_age) + 1).alias("Age_i"),
        year.alias("Year"), (at - F.min(at).over(Window.partitionBy("Country")) + 1).alias("Time"), F.bround("Births").cast("long").alias("births"))


def model_obs(births: DataFrame, cfg: CohortConfig) -> DataFrame:
    """J1 observation table: obs index ``i`` (rows ordered by Cohort, Age as the reference's
    grouped summary), dispersion index (B8) and the per-country dimensions (D19)."""
    obs = fit_window_obs(births, cfg)
    dims = obs.groupBy("Country").agg(
        F.countDistinct("Age_i").alias("n_ages_obs"), F.countDistinct("Time").alias("T_insample")
    )
    # one row per country; AQE turns this into a broadcast join on the measured size
    o = obs.join(dims, "Country")
    n_obs, t_in, t = F.col("n_ages_obs"), F.col("T_insample"), F.col("Time")
    disp_ind = (
        F.when(F.col("Age_i") == 1, n_obs + t)
        .when(F.col("Age_i") == n_obs, n_obs + t_in + t)
        .otherwise(F.col("Age_i"))
    )
    w = Window.partitionBy("Country").orderBy("Cohort", "Age")
    return o.select(
        "Country",
        F.row_number().over(w).alias("i"),
        "Cohort",
        "Age",
        "Age_i",
        "Year",
        "Time",
        disp_ind.cast("int").alias("disp_ind"),
        "births",
        "n_ages_obs",
        "T_insample",
    )


def exposure_grid(expos: DataFrame, cfg: Windows) -> DataFrame:
    """B7 + C10 + B10: in-sample exposure on the full (model age x cohort) grid, missing -> 0."""
    assert_axis(expos, "Cohort")
    jo = cfg.jump_off
    e = (
        cfg.attach(expos).withColumn("Year", F.col("Cohort") + F.col("Age"))
        .filter(
            (F.col("Year") <= jo)
            & (F.col("Cohort") <= jo - cfg.first_data_age)
            & (F.col("Cohort") >= cfg.first_full_cohort)
            & (F.col("Age") >= cfg.minimum_age)
            & (F.col("Age") <= cfg.maximum_age)
        )
        .select("Country", "Age", "Cohort", "Exposure")
    )
    grid = (
        cfg.attach(expos.select("Country").distinct())
        .select("*", F.explode(F.sequence(F.lit(cfg.minimum_age), F.lit(cfg.maximum_age))).alias("Age"))
        .select("*", F.explode(F.sequence(F.lit(cfg.first_full_cohort), F.lit(cfg.last_insample_cohort))).alias("Cohort"))
    )
    return grid.join(e, ["Country", "Age", "Cohort"], "left").select(
        "Country",
        "Age",
        "Cohort",
        (F.col("Cohort") - F.lit(cfg.first_full_cohort - 1)).alias("Time"),
        F.coalesce(F.col("Exposure"), F.lit(0.0)).alias("Exposure"),
    )


def period_exposure(expos: DataFrame, cfg: Windows) -> DataFrame:
    """B7 on the period axis: exposure by age and year from max(1950, first_year) to the jump-off year, on the grid of the
    ages and years that a country has there, missing -> 0.  Ages are not restricted."""
    assert_axis(expos, "Year")
    e = cfg.attach(expos).filter((F.col("Year") >= cfg.first_period) & (F.col("Year") <= cfg.jump_off))
    e = e.select("Country", "Age", "Year", "Exposure", F.lit(cfg.first_period).alias("first_period"))
    years = e.groupBy("Country").agg(F.collect_set("Year").alias("years"), F.first("first_period").alias("first_period"))
    grid = e.select("Country", "Age").distinct().join(years, "Country").select(
        "Country", "Age", "first_period", F.explode("years").alias("Year"))
    return grid.join(e.drop("first_period"), ["Country", "Age", "Year"], "left").select(
        "Country", "Age", "Year", (F.col("Year") - F.col("first_period") + 1).cast("int").alias("Time"),
        F.coalesce("Exposure", F.lit(0.0)).alias("Exposure"))


def exposure_pivot(grid: DataFrame, cfg: CohortConfig) -> DataFrame:
    """H1: Age x Cohort exposure matrix (export form).  The pivot values are the
    configured cohort range, so no extra job runs to discover them."""
    cohorts = list(range(cfg.first_full_cohort, cfg.last_insample_cohort + 1))
    return grid.groupBy("Country", "Age").pivot("Cohort", cohorts).agg(F.max("Exposure"))


def spline_basis(obs: DataFrame, cfg: CohortConfig) -> DataFrame:
    """J2 (I13 + D25): dispersion basis on observed age indices 1..n_ages_obs, long form
    (Country, Age_i, k, value); the two outer raw columns are merged into their
    neighbours, so k runs 1..n_interior."""
    n_raw = cfg.n_interior_knots + 2
    n_merged = n_raw - 2
    ages = obs.groupBy("Country", "Age_i").agg(F.max("n_ages_obs").alias("n"))
    x = F.col("Age_i").cast("double")
    x_min, x_max = F.lit(1.0), F.col("n").cast("double")
    k = F.col("k")

    def raw(j):
        return basis_value(x, j, x_min, x_max, cfg.n_interior_knots)

    value = (
        raw(k + F.lit(1))
        + F.when(k == 1, raw(F.lit(1))).otherwise(F.lit(0.0))
        + F.when(k == n_merged, raw(F.lit(n_raw))).otherwise(F.lit(0.0))
    )
    return ages.select("Country", "Age_i", "n", F.explode(F.sequence(F.lit(1), F.lit(n_merged))).alias("k")).select(
        "Country", "Age_i", "k", value.alias("value")
    )


def run_spec_grid(
    countries: DataFrame,
    cfg: CohortConfig,
    param_types: tuple[str, ...] = PARAM_TYPES,
    model_names: tuple[str, ...] = ("mixture",),
    dispersions: tuple[str, ...] = ("variable",),
    exclude_dupls: bool = False,
    base_config: str = "model_base.yaml",
) -> DataFrame:
    """C13 + I23: every combination of the run dimensions, then the run spec overlaid on the settings of ``cfg`` (spec
    values win; ``param_func`` = [p1, p2]).  ``run_config`` overlays specs on a table of configurations instead."""

    def arr(values):
        return F.array(*[F.lit(v) for v in values])

    g = (
        countries.select(F.col("Country").alias("country")).distinct()
        .select("country", F.explode(arr(param_types)).alias("param_type_1"))
        .select("*", F.explode(arr(param_types)).alias("param_type_2"))
        .select("*", F.explode(arr(model_names)).alias("model_name"))
        .select("*", F.explode(arr(dispersions)).alias("dispersion"))
    )
    if exclude_dupls:
        g = g.filter(F.col("param_type_1") != F.col("param_type_2"))
    return g.select(
        "param_type_1",
        "param_type_2",
        "model_name",
        "country",
        "dispersion",
        F.lit(base_config).alias("base_config"),
        # overlay: spec columns replace base values
        F.coalesce(F.col("model_name"), F.lit(cfg.model)).alias("model"),
        F.lit(cfg.time_dimension).alias("time_dimension"),
        F.lit(cfg.minimum_age).alias("minimum_age"),
        F.lit(cfg.maximum_age).alias("maximum_age"),
        F.lit(cfg.T_holdback).alias("T_holdback"),
        F.lit(cfg.T_forecast).alias("T_forecast"),
        F.concat_ws(",", "param_type_1", "param_type_2").alias("param_func"),
    )


def run_config(specs: DataFrame, models: DataFrame, countries: DataFrame) -> DataFrame:
    """A10 + I23 + B20: the settings of each run, one row per row of ``specs`` (Country, base_config and any of
    param_type_1, param_type_2, model_name, dispersion; null or absent: as in the base).

    A spec's values replace those of the model configuration it names (``models``, by ``name``), and the country's
    configuration (``countries``, by ``name``) is put beside them.  A spec that names an unknown one raises."""
    given = {c.lower() for c in specs.columns}
    own = {c: F.col(f"s.{c}") if c in given else F.lit(None).cast("string") for c in ("param_type_1", "param_type_2", "model_name", "dispersion")}
    j = (specs.alias("s").join(models.alias("m"), F.col("s.base_config") == F.col("m.name"), "left")
         .join(countries.alias("c"), F.col("s.Country") == F.col("c.name"), "left"))
    func = lambda k, spec: F.coalesce(spec, F.get(F.col("m.param_func"), F.lit(k)))
    known = F.when(F.col("m.name").isNull() | F.col("c.name").isNull(), F.raise_error(F.concat(
        F.lit("no configuration of "), F.coalesce("s.base_config", F.lit("null")), F.lit(" or "), F.col("s.Country"))))
    rest = lambda t, cols, skip: [F.col(f"{t}.{c}") for c in cols if c not in skip]
    r = j.select(
        F.coalesce(known.cast("string"), F.col("s.Country")).alias("Country"), "s.base_config",
        F.coalesce(own["model_name"], F.col("m.model")).alias("model"),
        F.coalesce(own["dispersion"], F.col("m.dispersion")).alias("dispersion"),
        F.array(func(0, own["param_type_1"]), func(1, own["param_type_2"])).alias("param_func"),
        *rest("m", models.columns, {"name", "model", "dispersion", "param_func"}), *rest("c", countries.columns, {"name"}))
    cohort = F.col("time_dimension") == "Cohort"
    period = F.greatest(F.lit(1950), F.col("first_year"))
    jump_off = F.col("last_year") - F.col("T_holdback")
    r = r.withColumns({"jump_off": jump_off, "start_time": F.when(cohort, F.col("first_full_cohort")).otherwise(period)})
    last = F.when(cohort, F.col("jump_off") - F.col("first_data_age")).otherwise(F.col("jump_off"))
    r = r.withColumn("T_insample", last - F.col("start_time") + 1)
    return r.withColumns({"T_total": F.col("T_insample") + F.col("T_forecast"), "n_ages": F.col("maximum_age") - F.col("minimum_age") + 1})
