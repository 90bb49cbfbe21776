"""Registered queries: configurations by country and run, both time axes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FIXTURE as C
from ..config import ConfigColumns
from ..operators import comparators as cmp
from ..operators import draws as dr
from ..operators import prep, rates
from ..operators.small import small_table
from ..sources import config_files as cf
from ..sources import files as fl
from ..sources import fixtures as fx
from .q_comparators import _FREEZE_CTE, _FREEZE_DOUBLES
from .q_draws import rate_draws_sql
from .q_prep import emp_rates
from .registry import register
from .views_sql import with_views

#: What the files in ``run_configs`` hold, for the SQL side.
_COUNTRIES = """(values ('AFRICA', 1995, 2001, 1944, 8, 52, 'Africa'), ('AMERICA', 1996, 2000, 1950, 10, 50, 'America'),
  ('ASIA', 1992, 2001, 1946, 9, 48, 'Asia'), ('EUROPE', 1993, 2001, 1940, 8, 52, 'Europe # all'),
  ('MIDDLE EAST', 1995, 1999, 1955, 12, 45, 'Middle East')) c(name, first_year, last_year, first_full_cohort, first_data_age, last_data_age, country)"""
_MODELS = """(values ('base', 'mixture', 'gamma_density', 'weibull_density', 'variable', 6, 55, 'Cohort', 2, 2, 8, 14, 50),
  ('short', 'mixture', 'gamma_density', 'hadwiger_density', 'constant', 8, 52, 'Cohort', 1, 3, 8, 16, 44),
  ('period', 'mixture', 'gamma_density', 'weibull_density', 'variable', 6, 55, 'Period', 2, 2, 8, 14, 50))
  m(name, model, p1, p2, dispersion, minimum_age, maximum_age, time_dimension, T_holdback, T_forecast, n_dispersion_basis, first_freeze_age, last_freeze_age)"""
_SPECS = """select r_name as Country, case r_name when 'AMERICA' then 'short' when 'EUROPE' then 'period' else 'base' end as base_config,
    case when r_name = 'ASIA' then 'poisson' end as dispersion, case when r_name = 'MIDDLE EAST' then 'hadwiger_density' end as param_type_2
  from region"""
_RUNS = f"""select *, case when time_dimension = 'Cohort' then jump_off - first_data_age else jump_off end - start_time + 1 as T_insample
  from (select s.Country, s.base_config, m.model, coalesce(s.dispersion, m.dispersion) as dispersion, m.p1, coalesce(s.param_type_2, m.p2) as p2,
    m.minimum_age, m.maximum_age, m.time_dimension, m.T_holdback, m.T_forecast, m.n_dispersion_basis, m.first_freeze_age, m.last_freeze_age,
    c.first_year, c.last_year, c.first_full_cohort, c.first_data_age, c.last_data_age, c.country as label,
    c.last_year - m.T_holdback as jump_off, greatest(1950, c.first_year) as first_period,
    case when m.time_dimension = 'Cohort' then c.first_full_cohort else greatest(1950, c.first_year) end as start_time
  from ({_SPECS}) s join {_MODELS} on m.name = s.base_config join {_COUNTRIES} on c.name = s.Country) r"""
_TRIANGLES = """select r_name as Country, cast(year(o_orderdate) as int) as Year, cast(l_quantity as int) + 5 as Age,
    cast(year(o_orderdate) as int) - (cast(l_quantity as int) + 5) as Cohort, month(o_orderdate) > 6 as after,
    cast(count(*) as double) as Births, cast(sum(cast(round(l_extendedprice*100) as bigint)) as double)/500000.0e0 as Exposure
  from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey
       join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey group by all"""
_SHAPES = """select 'VV' as lexis, Country, Year, Age, Cohort, sum(Births) as Births, sum(Exposure) as Exposure from triangles group by all
  union all
  select 'RR', Country, Year, case when after then Age else Age - 1 end, null, sum(Births), sum(Exposure) from triangles group by all"""
_VIEWS = {"runs": _RUNS, "triangles": _TRIANGLES, "shapes": _SHAPES}
_DEPS = {"runs": [], "triangles": [], "shapes": ["triangles"]}


def _v(sql: str, views: list[str], extra=None, deps=None) -> str:
    return with_views(sql, views, extra={**_VIEWS, **(extra or {})}, extra_deps={**_DEPS, **(deps or {})})


def run_specs(spark, sf_dir):
    """One run for each country: the base it builds on, and what it changes there."""
    c = F.col("Country")
    return fx.countries(spark, sf_dir).select(
        "Country", F.when(c == "AMERICA", "short").when(c == "EUROPE", "period").otherwise("base").alias("base_config"),
        F.when(c == "ASIA", "poisson").alias("dispersion"), F.when(c == "MIDDLE EAST", "hadwiger_density").alias("param_type_2"))


def runs(spark, sf_dir):
    """The runs' settings, read from YAML files, one row per country; made once per session."""
    def build():
        models = cf.read_configs(spark, cf.land_configs(spark, "model"), cf.MODEL_COLUMNS)
        countries = cf.read_configs(spark, cf.land_configs(spark, "country"), cf.COUNTRY_COLUMNS).withColumnRenamed("country", "label")
        return prep.run_config(run_specs(spark, sf_dir), models, countries)

    return small_table(spark, ("runs", sf_dir), build, broadcast=False)


def config(spark, sf_dir) -> ConfigColumns:
    return ConfigColumns(runs(spark, sf_dir))


def shapes(spark, sf_dir):
    return rates.lexis_shapes(fx.triangles(spark, sf_dir))


_RUN_COLUMNS = ("Country base_config model dispersion minimum_age maximum_age time_dimension T_holdback T_forecast n_dispersion_basis "
                "first_freeze_age last_freeze_age first_year last_year first_full_cohort first_data_age last_data_age label "
                "jump_off start_time").split()


@register("run_config", "A10 I23 B20", _v(f"""
select {', '.join('r.' + c for c in _RUN_COLUMNS)}, r.p1 || ',' || r.p2 as param_func, r.T_insample, r.T_insample + r.T_forecast as T_total,
       r.maximum_age - r.minimum_age + 1 as n_ages, count(c.Births) as n_cells, coalesce(sum(c.Births), 0.0e0) as Births
from runs r left join cells c on c.Country = r.Country and c.Year <= r.jump_off and c.Age between r.minimum_age and r.maximum_age
  and case when r.time_dimension = 'Cohort' then c.Cohort else c.Year end >= r.start_time
group by all""", ["runs", "cells"]), ["Births"])
def q_run_config(spark, sf_dir):
    r, c = runs(spark, sf_dir).alias("r"), fx.cells_checkpointed(spark, sf_dir).alias("c")
    at = F.when(F.col("time_dimension") == "Cohort", F.col("c.Cohort")).otherwise(F.col("c.Year"))
    inside = ((F.col("c.Country") == F.col("r.Country")) & (F.col("c.Year") <= F.col("jump_off")) & (at >= F.col("start_time"))
              & F.col("c.Age").between(F.col("minimum_age"), F.col("maximum_age")))
    own = [F.col(f"r.{c}").alias(c) for c in _RUN_COLUMNS]
    return r.join(c, inside, "left").groupBy(*own, F.concat_ws(",", "param_func").alias("param_func"), "T_insample", "T_total", "n_ages").agg(
        F.count("c.Births").alias("n_cells"), F.coalesce(F.sum("c.Births"), F.lit(0.0)).alias("Births"))


@register("fit_window_by_config", "A10 B1 B2 B4 B6 I23", _v("""
select f.Country, f.Cohort, f.Age, f.Age - r.first_data_age + 1 as Age_i, f.Cohort + f.Age as Year,
       f.Cohort - min(f.Cohort) over (partition by f.Country) + 1 as Time, cast(round_even(f.Births, 0) as bigint) as births
from (select c.Country, c.Cohort, greatest(least(c.Age, r.last_data_age), r.first_data_age) as Age, sum(c.Births) as Births
      from cells c join runs r on r.Country = c.Country group by all) f join runs r on r.Country = f.Country
where f.Cohort >= r.first_full_cohort and f.Cohort + f.Age <= r.jump_off""", ["cells", "runs"]))
def q_fit_window_by_config(spark, sf_dir):
    return prep.fit_window_obs(fx.births_table(spark, sf_dir), config(spark, sf_dir))


@register("exposure_by_config", "A10 B7 C10 B10 I23", _v("""
select g.Country, g.Age, g.Cohort, cast(g.Cohort - g.first_full_cohort + 1 as int) as Time, coalesce(e.Exposure, 0.0e0) as Exposure
from (select Country, cast(unnest(range(minimum_age, maximum_age + 1)) as int) as Age, Cohort, jump_off, first_data_age, first_full_cohort
      from (select *, cast(unnest(range(first_full_cohort, jump_off - first_data_age + 1)) as int) as Cohort from runs
            where Country in (select Country from cells)) a) g
left join cells e on e.Country = g.Country and e.Age = g.Age and e.Cohort = g.Cohort and e.Cohort + e.Age <= g.jump_off""",
                                                                          ["cells", "runs"]), ["Exposure"])
def q_exposure_by_config(spark, sf_dir):
    return prep.exposure_grid(fx.exposure_table(spark, sf_dir), config(spark, sf_dir))


_FREEZE_RUNS = (_FREEZE_CTE.replace(f"- {C.T_holdback} as Jump_off from rates", "- r.T_holdback as Jump_off, r.first_freeze_age, r.last_freeze_age "
                                    "from rates join (select Country as rc, T_holdback, first_freeze_age, last_freeze_age from runs) r on rc = rates.Country")
                .replace("max(Year) over (partition by Country)", "max(Year) over (partition by rates.Country)")
                .replace(f"r.Age >= {C.freeze_ages[0]} and r.Age <= {C.freeze_ages[1]}", "r.Age >= r.first_freeze_age and r.Age <= r.last_freeze_age"))


@register("freeze_by_config", "A10 N1 E1 C2 I23", _v("", ["rates", "runs"]) + _FREEZE_RUNS + " select * from frz", _FREEZE_DOUBLES)
def q_freeze_by_config(spark, sf_dir):
    return cmp.freeze_forecast(emp_rates(spark, sf_dir), config(spark, sf_dir))


@register("lexis_extracts", "A1 A2 A3 A4 C1 B9", _v(
    "select lexis, Country, Year, Age, coalesce(Cohort, 0) as Cohort, Exposure, Births, Births/Exposure as Rate from shapes", ["shapes"]),
    ["Exposure", "Births", "Rate"])
def q_lexis_extracts(spark, sf_dir):
    """Both shapes landed side by side, each read back on its own and rates made of it; squares have cohort 0."""
    base = fl.shared_dir(spark, "lexis")
    both = small_table(spark, ("lexis", sf_dir), lambda: shapes(spark, sf_dir), broadcast=False)
    for lexis in fl.LEXIS.values():
        cells = both.filter(F.col("lexis") == lexis).drop("lexis")
        fl.write_extracts(cells.drop("Exposure"), cells.drop("Births"), base, lexis, mode="append")
    found = []
    for dimension, lexis in fl.LEXIS.items():
        births, expos = (fl.read_item(spark, base, item, lexis).drop("OpenInterval") for item in ("births", "expos"))
        keys = ["Country", "Year", "Age"] + ["Cohort"] * (dimension == "Cohort")
        r = rates.empirical_rates(expos, births, keys).withColumn("Cohort", F.coalesce("Cohort", F.lit(0)))
        found.append(r.select(F.lit(lexis).alias("lexis"), "Country", "Year", "Age", "Cohort", "Exposure", "Births", "Rate"))
    return found[0].unionByName(found[1])


@register("axis_window_obs", "A3 B1 B4 B5 B6", _v("""
select f.Country, f.lexis, f.Axis_time, f.Age, f.Age - r.first_data_age + 1 as Age_i,
       case when r.time_dimension = 'Cohort' then f.Axis_time + f.Age else f.Axis_time end as Year,
       f.Axis_time - min(f.Axis_time) over (partition by f.Country) + 1 as Time, cast(round_even(f.Births, 0) as bigint) as births
from (select s.Country, s.lexis, case when r.time_dimension = 'Cohort' then s.Cohort else s.Year end as Axis_time,
             greatest(least(s.Age, r.last_data_age), r.first_data_age) as Age, sum(s.Births) as Births
      from shapes s join runs r on r.Country = s.Country and s.lexis = case when r.time_dimension = 'Cohort' then 'VV' else 'RR' end
      group by all) f join runs r on r.Country = f.Country
where f.Axis_time >= r.start_time and case when r.time_dimension = 'Cohort' then f.Axis_time + f.Age else f.Axis_time end <= r.jump_off""",
                                                     ["shapes", "runs"]))
def q_axis_window_obs(spark, sf_dir):
    return prep.axis_window_obs(shapes(spark, sf_dir), config(spark, sf_dir))


@register("period_exposure", "A3 B7 B20", _v("""
, e as (select s.Country, s.Age, s.Year, s.Exposure, r.first_period from shapes s join runs r on r.Country = s.Country
        where s.lexis = 'RR' and s.Year >= r.first_period and s.Year <= r.jump_off)
select a.Country, a.Age, y.Year, cast(y.Year - y.first_period + 1 as int) as Time, coalesce(e.Exposure, 0.0e0) as Exposure
from (select distinct Country, Age from e) a join (select distinct Country, Year, first_period from e) y on y.Country = a.Country
     left join e on e.Country = a.Country and e.Age = a.Age and e.Year = y.Year""", ["shapes", "runs"]), ["Exposure"])
def q_period_exposure(spark, sf_dir):
    squares = shapes(spark, sf_dir).filter("lexis = 'RR'").select("Country", "Year", "Age", "Exposure")
    return prep.period_exposure(squares, config(spark, sf_dir))


_AXIS = {"axis_draws": f"""select d.Country, d.Sim, r.time_dimension, r.start_time + (d.Cohort - {C.first_full_cohort}) as Cohort,
    case when r.time_dimension = 'Cohort' then 'CEB' else 'TFR' end as level, d.CEB, d.mode_age_gap, d.mode_age_sum, d.sd_1, d.sd_2, d.logit_mixture
  from draws d join runs r on r.Country = d.Country where d.Cohort - {C.first_full_cohort} + 1 <= r.T_insample + r.T_forecast""",
         "axis_rates": rate_draws_sql("gamma_density", "weibull_density", "axis_draws", ", time_dimension, level, CEB")}
_AXIS_DEPS = {"axis_draws": ["draws", "runs"], "axis_rates": ["axis_draws"]}


def axis_rates(spark, sf_dir):
    on_axis = dr.on_time_axis(fx.draws(spark, sf_dir, C), runs(spark, sf_dir), C.first_full_cohort)
    return dr.rate_draws(on_axis, C, ("gamma_density", "weibull_density"), axis="Time", keep=["time_dimension", "level", "CEB"])


@register("period_rate_draws", "B20 J3 J5 J11", _v(
    "select Country, Sim, Cohort as Year, Age, CEB as TFR, Rate from axis_rates where level = 'TFR'", ["axis_rates"], _AXIS, _AXIS_DEPS),
    ["TFR", "Rate"], overrides={"TFR": 9, "Rate": 7})
def q_period_rate_draws(spark, sf_dir):
    r = axis_rates(spark, sf_dir).filter("level = 'TFR'")
    return r.select("Country", "Sim", F.col("Time").alias("Year"), "Age", F.col("CEB").alias("TFR"), "Rate")


@register("axis_totals", "B20 J5 J11 D2", _v("""
select Country, time_dimension, level as level_name, Cohort as Time, count(*) as n_draws, avg(lv) as Level, avg(total) as Total
from (select Country, time_dimension, level, Cohort, Sim, max(CEB) as lv, sum(Rate) as total from axis_rates group by all) t group by all""",
                                            ["axis_rates"], _AXIS, _AXIS_DEPS), ["Level", "Total"])
def q_axis_totals(spark, sf_dir):
    per_draw = axis_rates(spark, sf_dir).groupBy("Country", "time_dimension", "level", "Time", "Sim").agg(
        F.max("CEB").alias("lv"), F.sum("Rate").alias("total"))
    return per_draw.groupBy("Country", "time_dimension", F.col("level").alias("level_name"), "Time").agg(
        F.count(F.lit(1)).alias("n_draws"), F.avg("lv").alias("Level"), F.avg("total").alias("Total"))
