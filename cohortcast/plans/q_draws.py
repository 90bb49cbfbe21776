"""Registered queries: posterior reconstruction."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..config import FIXTURE as C
from ..functions import densities as dens
from ..operators import draws as dr
from ..sources import fixtures as fx
from .registry import register
from .views_sql import with_views

_T0 = C.start_time - 1
_AMIN = C.minimum_age

DRAWS_LONG_SQL = f"""
select Country, Sim, Chain, Iter, 'CEB[' || (Cohort - {_T0}) || ']' as param, CEB as value from draws
union all select Country, Sim, Chain, Iter, 'mode_age_gap[' || (Cohort - {_T0}) || ']', mode_age_gap from draws
union all select Country, Sim, Chain, Iter, 'mode_age_sum[' || (Cohort - {_T0}) || ']', mode_age_sum from draws
union all select Country, Sim, Chain, Iter, 'sd_age[1,' || (Cohort - {_T0}) || ']', sd_1 from draws
union all select Country, Sim, Chain, Iter, 'sd_age[2,' || (Cohort - {_T0}) || ']', sd_2 from draws
union all select Country, Sim, Chain, Iter, 'logit_mixture[' || (Cohort - {_T0}) || ']', logit_mixture from draws"""

_NAME_RE = dr.NAME_RE


def draws(spark, sf_dir):
    return fx.draws(spark, sf_dir, C)


@register("draws_unpivot", "H6 A13", with_views(DRAWS_LONG_SQL, ["draws"]), ["value"], overrides={"value": 9})
def q_draws_unpivot(spark, sf_dir):
    return dr.draws_long(draws(spark, sf_dir), C)


_PARSE_SQL = f"""
select Country, param, regexp_replace(param, '\\[[0-9]{{1,}},*[0-9]*\\]', '') as Family,
       cast(regexp_extract(param, '{_NAME_RE}', 2) as int) as idx1,
       coalesce(cast(nullif(regexp_extract(param, '{_NAME_RE}', 3), '') as int), 0) as idx2,
       case when regexp_extract(param, '{_NAME_RE}', 3) = '' then 1 else 2 end as rank,
       count(*) as n_draws, avg(value) as mean
from dl group by all"""


@register("draw_names_parse", "H10 I16 D15",
          with_views(_PARSE_SQL, ["dl"], extra={"dl": DRAWS_LONG_SQL}, extra_deps={"dl": ["draws"]}),
          ["mean"], overrides={"mean": 9})
def q_draw_names_parse(spark, sf_dir):
    p = dr.parse_param_names(dr.draws_long(draws(spark, sf_dir), C))
    # idx2 = 0 marks a one-index parameter (indices are 1-based)
    p = p.withColumn("idx2", F.coalesce(F.col("idx2"), F.lit(0)))
    return p.groupBy("Country", "param", "Family", "idx1", "idx2", "rank").agg(
        F.count(F.lit(1)).alias("n_draws"), F.avg("value").alias("mean")
    )


_SD_SQL = f"""
select Country, Sim, cast(regexp_extract(param, '{_NAME_RE}', 3) as int) + {_T0} as Cohort,
       max(case when regexp_extract(param, '{_NAME_RE}', 2) = '1' then value end) as Sd_1,
       max(case when regexp_extract(param, '{_NAME_RE}', 2) = '2' then value end) as Sd_2
from dl where param like 'sd_age[%' group by all"""


@register("draws_pivot_sd", "H2 J4 J7 X19",
          with_views(_SD_SQL, ["dl"], extra={"dl": DRAWS_LONG_SQL}, extra_deps={"dl": ["draws"]}),
          ["Sd_1", "Sd_2"], overrides={"Sd_1": 9, "Sd_2": 9})
def q_draws_pivot_sd(spark, sf_dir):
    return dr.pivot_sd(dr.draws_long(draws(spark, sf_dir), C), C)


@register("locations", "J6 J3 C3",
          with_views("select Country, Sim, Cohort, 0.5e0*(mode_age_sum - mode_age_gap) as Mode_1, "
                     "0.5e0*(mode_age_sum + mode_age_gap) as Mode_2 from draws", ["draws"]),
          ["Mode_1", "Mode_2"], overrides={"Mode_1": 9, "Mode_2": 9})
def q_locations(spark, sf_dir):
    return dr.locations(draws(spark, sf_dir))


@register("mixture_weight", "J5 J8 I5",
          with_views("select Country, Sim, Cohort, CEB, 1.0e0/(1.0e0 + exp(-logit_mixture)) as Mixture from draws",
                     ["draws"]),
          ["CEB", "Mixture"], overrides={"CEB": 9, "Mixture": 9})
def q_mixture_weight(spark, sf_dir):
    return dr.mixture_weight(draws(spark, sf_dir), C)


# --- density SQL (oracle side) -------------------------------------------------
def gamma_sql(x: str, loc: str, s: str) -> str:
    rate = f"(({loc}) + sqrt(({loc})*({loc}) + 4.0e0*({s})*({s})))/(2.0e0*({s})*({s}))"
    shape = f"(({loc})*{rate} + 1.0e0)"
    return f"exp({shape}*ln({rate}) - lgamma({shape}) + ({shape} - 1.0e0)*ln({x}) - {rate}*({x}))"


def weibull_sql(x: str, loc: str, s: str) -> str:
    k = f"(ln(2.0e0)/(ln(({loc}) + ({s})) - ln({loc})))"
    lam = f"(({loc})/pow(ln(2.0e0), 1.0e0/{k}))"
    return f"(case when ({loc}) <= 0 then 'nan'::double else ({k}/{lam})*pow(({x})/{lam}, {k} - 1.0e0)*exp(-pow(({x})/{lam}, {k})) end)"


def hadwiger_sql(x: str, loc: str, s: str) -> str:
    log_h = f"(ln({loc}) - 0.5e0*ln(2.0e0) - ln({s}))"
    part1 = f"({log_h} - ln({loc}) - 0.5e0*ln(pi()))"
    return (f"(case when ({loc}) <= 0 then 'nan'::double else exp({part1} + 1.5e0*ln({loc}) - 1.5e0*ln({x}) "
            f"- exp({log_h})*exp({log_h})*(({loc})/({x}) + ({x})/({loc}) - 2.0e0)) end)")


DENS_SQL = {"gamma_density": gamma_sql, "weibull_density": weibull_sql, "hadwiger_density": hadwiger_sql}


def rate_draws_sql(f1: str, f2: str, draws_view: str = "draws", extra_cols: str = "") -> str:
    x = "(cast(a.range as double) - 0.5e0)"
    return f"""
select Country, Sim, Cohort{extra_cols}, cast(a.range + {_AMIN - 1} as int) as Age,
       w1*{DENS_SQL[f1](x, 'l1', 'sd_1')} as Comp_1, w2*{DENS_SQL[f2](x, 'l2', 'sd_2')} as Comp_2,
       w1*{DENS_SQL[f1](x, 'l1', 'sd_1')} + w2*{DENS_SQL[f2](x, 'l2', 'sd_2')} as Rate
from (select *, CEB*(1.0e0/(1.0e0 + exp(-logit_mixture))) as w1,
             CEB*(1.0e0 - 1.0e0/(1.0e0 + exp(-logit_mixture))) as w2,
             0.5e0*(mode_age_sum - mode_age_gap) - {float(_AMIN)!r}e0 as l1,
             0.5e0*(mode_age_sum + mode_age_gap) - {float(_AMIN)!r}e0 as l2 from {draws_view}) d,
     range(1, {C.n_ages + 1}) a"""


_RATE_DOUBLES = ["Comp_1", "Comp_2", "Rate"]
_R9 = {c: 9 for c in _RATE_DOUBLES}


@register("rate_draws_gamma_weibull", "J9 J10 J11 I1 I2 I4 B18",
          with_views(rate_draws_sql("gamma_density", "weibull_density"), ["draws"]), _RATE_DOUBLES, overrides=_R9)
def q_rate_draws_gamma_weibull(spark, sf_dir):
    return dr.rate_draws(draws(spark, sf_dir), C, ("gamma_density", "weibull_density"))


@register("rate_draws_hadwiger", "J9 J10 J11 I3 I4",
          with_views(rate_draws_sql("hadwiger_density", "hadwiger_density"), ["draws"]), _RATE_DOUBLES, overrides=_R9)
def q_rate_draws_hadwiger(spark, sf_dir):
    return dr.rate_draws(draws(spark, sf_dir), C, ("hadwiger_density", "hadwiger_density"))


_PROBS = ", ".join(f"{i / 100!r}e0" for i in range(1, 100))
_RQ_SQL = f"""
, rl AS (select Country, Sim, Cohort, Age, 'Component One' as Component, Comp_1 as Value from rd
         union all select Country, Sim, Cohort, Age, 'Component Two', Comp_2 from rd
         union all select Country, Sim, Cohort, Age, 'Rate', Rate from rd)
, q AS (select Country, Age, Cohort, Component, quantile_cont(Value, [{_PROBS}]) as qs from rl group by all)
select Country, Age, Cohort, Component, cast(unnest(range(1, 100)) as double)/100.0e0 as Quantile, unnest(qs) as Rate
from q"""


_RD_VIEW = {"rd": rate_draws_sql("gamma_density", "weibull_density")}


@register("rate_quantiles", "J12 D14 H8 U4",
          with_views("", ["rd"], extra=_RD_VIEW, extra_deps={"rd": ["draws"]}) + _RQ_SQL,
          ["Quantile", "Rate"], overrides={"Rate": 9})
def q_rate_quantiles(spark, sf_dir):
    return dr.rate_quantiles(dr.rate_draws(draws(spark, sf_dir), C, ("gamma_density", "weibull_density")))


_FANS = ", ".join(f"{p!r}e0" for p in dr.FAN_PROBS)
_FAN_SQL = f"""
, pl AS (select Country, Sim, Cohort, 'CFS' as param, CEB as value from draws
         union all select Country, Sim, Cohort, 'Mode_1', 0.5e0*(mode_age_sum - mode_age_gap) from draws
         union all select Country, Sim, Cohort, 'Mode_2', 0.5e0*(mode_age_sum + mode_age_gap) from draws
         union all select Country, Sim, Cohort, 'Sd_1', sd_1 from draws
         union all select Country, Sim, Cohort, 'Sd_2', sd_2 from draws
         union all select Country, Sim, Cohort, 'Mixture', 1.0e0/(1.0e0 + exp(-logit_mixture)) from draws)
, q AS (select Country, param, Cohort, quantile_cont(value, [{_FANS}]) as qs from pl group by all)
select Country, param, Cohort, unnest([{_FANS}]) as Quantile, unnest(qs) as value from q"""


@register("parameter_fans", "J13", with_views("", ["draws"]) + _FAN_SQL, ["Quantile", "value"], overrides={"value": 9})
def q_parameter_fans(spark, sf_dir):
    return dr.parameter_fans(draws(spark, sf_dir), C)


def normal_density(x, loc, scale):
    """A density of the user's own: normal in age."""
    z = (x - loc) / scale
    return F.exp(F.lit(-0.5) * z * z) / (scale * F.lit(math.sqrt(2.0 * math.pi)))


_LEVELS = "CEB*(1.0e0/(1.0e0 + exp(-logit_mixture)))", "CEB*(1.0e0 - 1.0e0/(1.0e0 + exp(-logit_mixture)))"
_NORMAL = "exp(-0.5e0*((x - {m})/{s})*((x - {m})/{s}))/({s}*sqrt(2.0e0*pi()))"
_REGISTERED_SQL = f"""
select Country, Sim, cast(Cohort as bigint) as Cohort, Age, avg_1 as Comp_1, avg_2 as Comp_2, avg_1 + avg_2 as Rate
from (select Country, Sim, Cohort, cast(a.range + {_AMIN - 1} as int) as Age, w1*{_NORMAL.format(m='l1', s='sd_1')} as avg_1,
             w2*{_NORMAL.format(m='l2', s='sd_2')} as avg_2
      from (select *, {_LEVELS[0]} as w1, {_LEVELS[1]} as w2, 0.5e0*(mode_age_sum - mode_age_gap) - {_AMIN}.0e0 as l1,
                   0.5e0*(mode_age_sum + mode_age_gap) - {_AMIN}.0e0 as l2 from draws where Cohort > {C.jump_off - C.first_data_age}) d,
           range(1, {C.n_ages + 1}) a, (select 0.5e0 as half) h, lateral (select cast(a.range as double) - half as x) xx) q"""


@register("rate_draws_registered", "U1 J9 J10", with_views(_REGISTERED_SQL, ["draws"]), ["Comp_1", "Comp_2", "Rate"],
          overrides={"Comp_1": 7, "Comp_2": 7, "Rate": 7})
def q_rate_draws_registered(spark, sf_dir):
    """Schedules of the cohorts without observations by a density that the user registers."""
    dens.register_density("normal_density", normal_density)
    try:
        rates = dr.rate_draws(draws(spark, sf_dir).filter(F.col("Cohort") > C.jump_off - C.first_data_age), C, ("normal_density", "normal_density"))
    finally:
        dens.DENSITIES.pop("normal_density")
    return rates.select("Country", "Sim", F.col("Cohort").cast("long").alias("Cohort"), F.col("Age").cast("int").alias("Age"), "Comp_1", "Comp_2", "Rate")
