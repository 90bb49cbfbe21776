"""Registered queries: rates and model inputs."""

from __future__ import annotations

from ..config import FIXTURE as C
from ..operators import prep, rates
from ..sources import fixtures as fx
from .registry import register
from .views_sql import with_views


def emp_rates(spark, sf_dir, materialized: bool = True):
    """Observed rates.  Births and exposure of the fixture live in one aggregate, so the
    default reads the once-materialised cells and divides in the row; the C1 left join
    of two separately landed tables is exercised by ``empirical_rate``/``landed_rates``."""
    if materialized:
        return rates.cell_rates(fx.cells_checkpointed(spark, sf_dir)).select(
            "Country", "Year", "Age", "Cohort", "Exposure", "Births", "Rate")
    # C1 on the two extracts; both are taken from the once-materialised cells so the fact
    # tables are not scanned twice for one query (separately landed files: landed_rates)
    return rates.empirical_rates(fx.exposure_table(spark, sf_dir, True), fx.births_table(spark, sf_dir, True))


def obs_table(spark, sf_dir, materialized: bool = True):
    return prep.model_obs(fx.births_table(spark, sf_dir, materialized), C)


def expo_grid(spark, sf_dir, materialized: bool = True):
    return prep.exposure_grid(fx.exposure_table(spark, sf_dir, materialized), C)


@register("empirical_rate", "C1 B9", with_views("select * from rates", ["rates"]), ["Exposure", "Births", "Rate"])
def q_empirical_rate(spark, sf_dir):
    return emp_rates(spark, sf_dir, materialized=False)


@register("birth_totals_clamped", "B1 D1", with_views("select * from births_c", ["births_c"]), ["Births"])
def q_birth_totals_clamped(spark, sf_dir):
    return rates.births_clamped(fx.births_table(spark, sf_dir), "Cohort", C.first_data_age, C.last_data_age)


@register(
    "completed_family_size", "D2",
    with_views("select Country, Cohort, sum(Rate) as CFS, count(*) as n_ages from rates group by Country, Cohort", ["rates"]),
    ["CFS"],
)
def q_completed_family_size(spark, sf_dir):
    return rates.completed_family_size(emp_rates(spark, sf_dir), "Cohort")


@register(
    "period_total_rate", "D2 (period)",
    with_views("select Country, Year, sum(Rate) as TFR, count(*) as n_ages from rates group by Country, Year", ["rates"]),
    ["TFR"],
)
def q_period_total_rate(spark, sf_dir):
    return rates.completed_family_size(emp_rates(spark, sf_dir), "Year")


@register("fit_window_obs", "B1 B2 B3 B4 B6 B11 D1", with_views("select * from fitwin", ["fitwin"]))
def q_fit_window_obs(spark, sf_dir):
    return prep.fit_window_obs(fx.births_table(spark, sf_dir), C)


_PERIOD_SQL = f"""
, bp AS (select Country, Year, greatest(least(Age, {C.last_data_age}), {C.first_data_age}) as Age, sum(Births) as Births
         from cells group by Country, Year, greatest(least(Age, {C.last_data_age}), {C.first_data_age}))
select Country, Year, Age, Age - {C.first_data_age - 1} as Age_i,
       Year - min(Year) over (partition by Country) + 1 as Time,
       cast(round_even(Births, 0) as bigint) as births
from bp where Year >= {max(C.first_year, 1950)} and Year <= {C.last_year - C.T_holdback}"""


@register("period_window_obs", "B5 B6", with_views("", ["cells"]) + _PERIOD_SQL)
def q_period_window_obs(spark, sf_dir):
    return prep.period_window_obs(fx.births_table(spark, sf_dir), C)


@register("dispersion_index", "J1 B8 D19", with_views("select * from obs", ["obs"]))
def q_dispersion_index(spark, sf_dir):
    return obs_table(spark, sf_dir, materialized=False)


@register("exposure_grid", "B7 C10 B10", with_views("select * from expo_grid", ["expo_grid"]), ["Exposure"])
def q_exposure_grid(spark, sf_dir):
    return expo_grid(spark, sf_dir, materialized=False)


_COHORTS = list(range(C.first_full_cohort, C.last_insample_cohort + 1))
_PIVOT_SQL = "select Country, Age, " + ", ".join(
    f'max(Exposure) filter (where Cohort = {c}) as "{c}"' for c in _COHORTS
) + " from expo_grid group by Country, Age"


@register("exposure_pivot", "H1", with_views(_PIVOT_SQL, ["expo_grid"]), [str(c) for c in _COHORTS])
def q_exposure_pivot(spark, sf_dir):
    return prep.exposure_pivot(expo_grid(spark, sf_dir), C)


def _bspline_sql(u: str) -> str:
    return (
        f"(case when ({u}) >= 0 and ({u}) < 1 then pow({u}, 3)/6.0 "
        f"when ({u}) >= 1 and ({u}) < 2 then (-3*pow({u},3) + 12*pow({u},2) - 12*({u}) + 4)/6.0 "
        f"when ({u}) >= 2 and ({u}) < 3 then (3*pow({u},3) - 24*pow({u},2) + 60*({u}) - 44)/6.0 "
        f"when ({u}) >= 3 and ({u}) < 4 then pow(4 - ({u}), 3)/6.0 else 0.0 end)"
    )


def _raw_sql(j: str) -> str:
    gap = f"((n - 1.0)/{float(C.n_interior_knots - 1)})"
    knot = f"(1.0 - 3.0*{gap} + (({j}) - 1)*{gap})"
    return _bspline_sql(f"((cast(Age_i as double) - {knot})/{gap})")


_NM = C.n_interior_knots
SPLINE_SQL = f"""
select Country, Age_i, k,
  {_raw_sql('k + 1')} + (case when k = 1 then {_raw_sql('1')} else 0.0 end)
                      + (case when k = {_NM} then {_raw_sql(str(_NM + 2))} else 0.0 end) as value
from (select Country, Age_i, max(n_ages_obs) as n from obs group by Country, Age_i) a,
     (select cast(range as int) as k from range(1, {_NM + 1})) kk"""


@register("spline_basis", "I13 J2 D25", with_views(SPLINE_SQL, ["obs"]), ["value"], overrides={"value": 9})
def q_spline_basis(spark, sf_dir):
    return prep.spline_basis(obs_table(spark, sf_dir), C)


_TYPES = "(values ('gamma_density'), ('weibull_density'), ('hadwiger_density'))"
_RUNSPEC_SQL = f"""
select p1.p as param_type_1, p2.p as param_type_2, 'mixture' as model_name, c.Country as country,
       'variable' as dispersion, 'model_base.yaml' as base_config, 'mixture' as model,
       '{C.time_dimension}' as time_dimension, {C.minimum_age} as minimum_age, {C.maximum_age} as maximum_age,
       {C.T_holdback} as T_holdback, {C.T_forecast} as T_forecast, p1.p || ',' || p2.p as param_func
from (select r_name as Country from region) c cross join {_TYPES} p1(p) cross join {_TYPES} p2(p)"""


@register("run_spec_grid", "C13 I23", _RUNSPEC_SQL)
def q_run_spec_grid(spark, sf_dir):
    return prep.run_spec_grid(fx.countries(spark, sf_dir), C)


def small_basis(spark, sf_dir):
    from ..operators.small import small_table

    return small_table(spark, ("basis", sf_dir), lambda: prep.spline_basis(obs_table(spark, sf_dir, True), C))


# size-checked, once-per-session small sides of the draw-level joins
def small_obs(spark, sf_dir):
    from ..operators.small import small_table

    return small_table(spark, ("obs", sf_dir), lambda: obs_table(spark, sf_dir, True))


def small_grid(spark, sf_dir):
    from ..operators.small import small_table

    return small_table(spark, ("expo_grid", sf_dir), lambda: expo_grid(spark, sf_dir, True))


def small_observed(spark, sf_dir):
    from ..operators.likelihood import observed_grid
    from ..operators.small import small_table

    return small_table(spark, ("observed_grid", sf_dir), lambda: observed_grid(small_grid(spark, sf_dir), small_obs(spark, sf_dir), C))


def small_rates(spark, sf_dir):
    from ..operators.small import small_table

    return small_table(spark, ("rates", sf_dir), lambda: emp_rates(spark, sf_dir, True))
