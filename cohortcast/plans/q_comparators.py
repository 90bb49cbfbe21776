"""Registered queries: comparator forecasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FIXTURE as C
from ..operators import comparators as cmp
from ..sources import fixtures as fx
from .q_prep import emp_rates
from .registry import register
from .views_sql import with_views


def dsql(x: float) -> str:
    """A double literal that DuckDB parses exactly as Python's float."""
    return f"cast('{x!r}' as double)"


# ------------------------------------------------------------------ N1
_FL, _FH = C.freeze_ages
_FREEZE_CTE = f"""
, fr AS (select *, max(Year) over (partition by Country) - {C.T_holdback} as Jump_off from rates)
, fz AS (select Country, Age, Rate as Rate_freeze from fr where Year = Jump_off)
, fa AS (select r.*, z.Rate_freeze from fr r left join fz z on r.Country = z.Country and r.Age = z.Age
         where r.Year > r.Jump_off and r.Age >= {_FL} and r.Age <= {_FH})
, frz AS (select Country, Year, Age, Cohort, Births, Exposure, Rate, Jump_off, Rate_freeze,
    Rate_freeze - Rate as Bias_rate, abs(Rate_freeze - Rate) as AE_rate,
    (Rate_freeze - Rate)*(Rate_freeze - Rate) as SE_rate,
    abs(Rate_freeze - Rate)/(Rate_freeze + 1e-06) as PE_rate,
    Rate_freeze*Exposure as E_births, Rate_freeze*Exposure - Births as Bias_births,
    abs(Rate_freeze*Exposure - Births) as AE_births, abs(Rate_freeze*Exposure - Births)/Births as PE_births,
    (Rate_freeze*Exposure - Births)*(Rate_freeze*Exposure - Births) as SE_births
  from fa)"""

_ERR = ["Bias_rate", "AE_rate", "SE_rate", "PE_rate", "E_births", "Bias_births", "AE_births", "PE_births", "SE_births"]
_FREEZE_DOUBLES = ["Births", "Exposure", "Rate", "Rate_freeze"] + _ERR


def _wmean(x: str) -> str:
    return (f"(case when sum(case when Births <> 0 and {x} is null then 1 else 0 end) > 0 then null "
            f"else sum(case when Births <> 0 then Births*{x} end)/sum(Births) end)")


def _rmean(x: str) -> str:
    return f"(case when count({x}) < count(*) then null else avg({x}) end)"


_SUMMARY_COLS = ", ".join([
    f"{_wmean('Bias_rate')} as WBias_rate", f"{_wmean('AE_rate')} as WAE_rate",
    f"sqrt({_wmean('SE_rate')}) as WRMSE_rate", f"{_wmean('PE_rate')} as WPE_rate",
    f"{_wmean('E_births')} as WE_births", f"{_wmean('Bias_births')} as WBias_births",
    f"{_wmean('AE_births')} as WAE_births", f"{_wmean('PE_births')} as WPE_births",
    f"sqrt({_wmean('SE_births')}) as WRMSE_births",
    f"{_rmean('Bias_rate')} as Bias_rate", f"{_rmean('AE_rate')} as AE_rate",
    f"sqrt({_rmean('SE_rate')}) as RMSE_rate", f"{_rmean('PE_rate')} as PE_rate",
    f"{_rmean('E_births')} as E_births", f"{_rmean('Bias_births')} as Bias_births",
    f"{_rmean('AE_births')} as AE_births", f"{_rmean('PE_births')} as PE_births",
    f"sqrt({_rmean('SE_births')}) as RMSE_births",
])
_SUMMARY_DOUBLES = ["WBias_rate", "WAE_rate", "WRMSE_rate", "WPE_rate", "WE_births", "WBias_births", "WAE_births",
                    "WPE_births", "WRMSE_births", "Bias_rate", "AE_rate", "RMSE_rate", "PE_rate", "E_births",
                    "Bias_births", "AE_births", "PE_births", "RMSE_births"]


def freeze(spark, sf_dir):
    return cmp.freeze_forecast(emp_rates(spark, sf_dir), C)


@register("freeze_forecast", "N1 C2 E1", with_views("", ["rates"]) + _FREEZE_CTE + "\nselect * from frz",
          _FREEZE_DOUBLES)
def q_freeze_forecast(spark, sf_dir):
    return freeze(spark, sf_dir)


@register("freeze_summary", "N1 D6",
          with_views("", ["rates"]) + _FREEZE_CTE + f"\nselect Country, {_SUMMARY_COLS} from frz group by Country",
          _SUMMARY_DOUBLES)
def q_freeze_summary(spark, sf_dir):
    return cmp.freeze_summary(freeze(spark, sf_dir))


@register("freeze_by_age", "N1 D7",
          with_views("", ["rates"]) + _FREEZE_CTE
          + f"\nselect Age, Country, {_SUMMARY_COLS} from frz group by Age, Country",
          _SUMMARY_DOUBLES)
def q_freeze_by_age(spark, sf_dir):
    return cmp.freeze_by_age(freeze(spark, sf_dir))


# ------------------------------------------------------------------ N2-N5
_SL, _SH = C.slope_ages
_QZ = ", ".join(f"({dsql(q)}, {dsql(z)})" for q, z in cmp.normal_quantiles())
_SLOPE_CTE = f"""
, panel AS (select Country, Year, Age, Rate as ASFR from rates where Age >= {_SL} and Age <= {_SH})
, pos AS (select Country, Year, row_number() over (partition by Country order by Year) as pos,
                 count(*) over (partition by Country) as n_years from (select distinct Country, Year from panel) y)
, pos2 AS (select *, n_years - {C.n_holdback} as last_trend, n_years - {C.n_holdback + C.n_trend - 1} as first_trend from pos)
, fit AS (select p.Country, p.Age, max(case when q.pos = q.last_trend then p.ASFR end) as ax,
                 (max(case when q.pos = q.last_trend then p.ASFR end) - max(case when q.pos = q.first_trend then p.ASFR end))
                 / {float(C.n_trend - 1)!r}e0 as bx
          from panel p join pos2 q on p.Country = q.Country and p.Year = q.Year group by p.Country, p.Age)
, den AS (select Country, sum(bx*bx) as bxbx, count(bx) as n_bx, count(*) as n_ages from fit group by Country)
, tt AS (select p.Country, p.Year, sum(f.bx*(p.ASFR - f.ax)) as num, count(f.bx*(p.ASFR - f.ax)) as n_num
         from panel p join pos2 q on p.Country = q.Country and p.Year = q.Year
              join fit f on p.Country = f.Country and p.Age = f.Age
         where q.pos >= q.first_trend and q.pos <= q.last_trend group by p.Country, p.Year)
, ktt AS (select t.Country, t.Year, case when t.n_num = d.n_ages and d.n_bx = d.n_ages then t.num/d.bxbx end as kt
          from tt t join den d on t.Country = d.Country)
, ft AS (select Country, Year, kt, kt - lag(kt) over (partition by Country order by Year) - 1.0e0 as epsilon,
                row_number() over (partition by Country order by Year) as step from ktt)
, sig AS (select case when count(epsilon) < count(*) then null else var_samp(epsilon) end as sigma2,
                 count(*) as n_epsilon from ft where step > 1)
, jo AS (select Country, max(Year) - {C.n_predict} as jo from panel group by Country)
, qz AS (select * from (values {_QZ}) t(Quantile, z))
, sq AS (select f.Country, f.Age, j.jo + h.h as Year, qz.Quantile,
                (f.ax + f.bx*cast(least(h.h, {C.n_extrapolate}) as double))
                + sqrt(f.bx*f.bx*(cast(least(h.h, {C.n_extrapolate}) as double)*cast(least(h.h, {C.n_extrapolate}) as double)
                       *s.sigma2/{float(C.n_trend - 1)!r}e0 + h.h*s.sigma2))*qz.z as ASFR,
                abs(qz.Quantile - 0.5e0)*2.0e0 as Interval
         from fit f join jo j on f.Country = j.Country cross join sig s
              cross join (select cast(range as int) as h from range(1, {C.n_predict + 1})) h cross join qz)
, sa AS (select p.Country, p.Year, p.Age, p.ASFR, q.Quantile, q.ASFR as ASFR_predictions, q.Interval
         from panel p left join sq q on p.Country = q.Country and p.Age = q.Age and p.Year = q.Year)
, clean AS (select * from sa where Quantile is not null and ASFR_predictions is not null and Interval is not null
            and ASFR is not null and not isnan(ASFR) and not isnan(ASFR_predictions))"""


def _slope(sql: str) -> str:
    return with_views("", ["rates"]) + _SLOPE_CTE + "\n" + sql


def panel(spark, sf_dir):
    return cmp.slope_panel(emp_rates(spark, sf_dir), C)


@register("slope_fit_age", "N2 E3 E4", _slope("select * from fit"), ["ax", "bx"], overrides={"ax": 9, "bx": 9})
def q_slope_fit_age(spark, sf_dir):
    return cmp.slope_fit_age(panel(spark, sf_dir), C)


@register("slope_fit_time", "N2 E2 D22", _slope("select Country, Year, kt, epsilon from ft"), ["kt", "epsilon"])
def q_slope_fit_time(spark, sf_dir):
    return cmp.slope_fit_time(panel(spark, sf_dir), C)


@register("slope_sigma2", "N3 D21", _slope("select * from sig"), ["sigma2"], overrides={"sigma2": 9})
def q_slope_sigma2(spark, sf_dir):
    return cmp.slope_sigma2(cmp.slope_fit_time(panel(spark, sf_dir), C, with_step=True))


@register("slope_quantiles", "N4 E8 C14 H14 I10 I22", _slope("select * from sq"), ["Quantile", "ASFR", "Interval"],
          overrides={"ASFR": 9})
def q_slope_quantiles(spark, sf_dir):
    return cmp.slope_quantiles(panel(spark, sf_dir), C)


@register("slope_rmse", "N5 C9 D12 B16",
          _slope("select Country, sqrt(avg((ASFR_predictions - ASFR)*(ASFR_predictions - ASFR))) as RMSE "
                 "from clean where abs(Quantile - 0.5e0) < 0.01e0 group by Country"),
          ["RMSE"], overrides={"RMSE": 9})
def q_slope_rmse(spark, sf_dir):
    return cmp.slope_rmse(panel(spark, sf_dir), C)


def _q(p: float) -> str:
    return f"max(case when Quantile = {dsql(p)} then ASFR_predictions end)"


_COV_SQL = f"""
, wide AS (select Country, Year, Age, ASFR, {_q(0.025)} as Q2_5, {_q(0.05)} as Q5, {_q(0.1)} as Q10, {_q(0.25)} as Q25,
                  {_q(0.75)} as Q75, {_q(0.9)} as Q90, {_q(0.95)} as Q95, {_q(0.975)} as Q97_5
           from clean group by Country, Year, Age, ASFR)
, cov AS (select Country, avg(cast(ASFR > Q25 and ASFR < Q75 as double)) as I50,
                 avg(cast(ASFR > Q10 and ASFR < Q90 as double)) as I80,
                 avg(cast(ASFR > Q5 and ASFR < Q95 as double)) as I90,
                 avg(cast(ASFR > Q2_5 and ASFR < Q97_5 as double)) as I95 from wide group by Country)
select Country, 'I50' as Interval, I50 as Proportion from cov
union all select Country, 'I80', I80 from cov
union all select Country, 'I90', I90 from cov
union all select Country, 'I95', I95 from cov"""


@register("slope_coverage", "N5 D13 H3 H9", with_views("", ["rates"]) + _SLOPE_CTE + _COV_SQL, ["Proportion"])
def q_slope_coverage(spark, sf_dir):
    return cmp.slope_coverage(panel(spark, sf_dir), C)


# ------------------------------------------------------------------ N6-N8
@register("interval_scores", "N6 N7 D11",
          with_views("select Country, sqrt(avg((ASFR_prediction - ASFR)*(ASFR_prediction - ASFR))) as RMSE, "
                     "avg(cast(ASFR < p95 and ASFR > p5 as double)) as I90, "
                     "avg(cast(ASFR < p75 and ASFR > p25 as double)) as I50 "
                     "from posterior_quantiles where not V_ind group by Country", ["posterior_quantiles"]),
          ["RMSE", "I90", "I50"], overrides={"RMSE": 9})
def q_interval_scores(spark, sf_dir):
    return cmp.interval_scores(fx.posterior_quantiles(spark, sf_dir, C))


def _asfr_panels(spark, sf_dir):
    cells = fx.cells_checkpointed(spark, sf_dir)
    asfr = cells.select("Country", "Cohort", F.col("Age").alias("ARDY"), "Year",
                        (F.col("Births") / F.col("Exposure")).alias("ASFR"))
    expos = cells.select("Country", "Cohort", F.col("Age").alias("ARDY"), "Year", "Exposure")
    return asfr, expos


_CAL_CTE = f"""
, calib AS (select a.Country, a.Cohort, a.ARDY, a.Year, a.ASFR, e.Exposure
   from (select Country, Cohort, Age as ARDY, Year, Births/Exposure as ASFR from cells) a
   left join (select Country, Cohort, Age as ARDY, Year, Exposure from cells) e
     on a.Country = e.Country and a.Cohort = e.Cohort and a.ARDY = e.ARDY and a.Year = e.Year
   where a.Cohort >= {C.first_full_cohort} and a.ARDY between {_SL} and {_SH})"""


@register("calibration_panel", "N8 C8 B15", with_views("", ["cells"]) + _CAL_CTE + "\nselect * from calib",
          ["ASFR", "Exposure"], overrides={"ASFR": 9})
def q_calibration_panel(spark, sf_dir):
    asfr, expos = _asfr_panels(spark, sf_dir)
    return cmp.calibration_panel(asfr, expos, C)


@register("last_complete_cohort", "E9 D20",
          with_views("", ["cells"]) + _CAL_CTE + f"""
, per AS (select Country, Cohort, count(distinct ARDY) as n_ages from calib group by Country, Cohort)
select Country, min(Cohort) as first_cohort, max(Cohort) as last_cohort, cast(sum(n_ages) as bigint) as n_cells,
       max(n_ages) as max_ages_per_cohort,
       max(case when n_ages = {_SH - _SL + 1} then Cohort end) as last_complete_cohort
from per group by Country""")
def q_last_complete_cohort(spark, sf_dir):
    asfr, expos = _asfr_panels(spark, sf_dir)
    return cmp.last_complete_cohort(cmp.calibration_panel(asfr, expos, C), C)
