"""Registered queries: likelihood, prior and forecast scoring."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from ..config import FIXTURE as C
from ..operators import likelihood as lk
from ..operators import scoring as sc
from ..sources import fixtures as fx
from .q_draws import rate_draws_sql
from .q_prep import SPLINE_SQL, small_basis, small_observed, small_obs, small_rates
from .registry import register
from .views_sql import with_views

PF = ("gamma_density", "weibull_density")
_FDA, _LDA, _JO = C.first_data_age, C.last_data_age, C.jump_off


def nb_sql(y: str, mu: str, k: str) -> str:
    return (f"(lgamma(({y}) + ({k})) - lgamma({k}) - lgamma(({y}) + 1) + ({k})*ln(({k})/(({k}) + ({mu}))) "
            f"+ ({y})*ln(({mu})/(({k}) + ({mu}))))")


def poisson_sql(y: str, mu: str) -> str:
    return f"(case when ({y}) = 0 then -({mu}) else ({y})*ln({mu}) - ({mu}) - lgamma(({y}) + 1) end)"


# ------------------------------------------------------------------ J14 loglik
_EB_SQL = f"""
select r.Country, r.Sim, r.Chain, r.Iter, r.Cohort, greatest(least(r.Age, {_LDA}), {_FDA}) as Age,
       sum(1e-06 + r.Rate*g.Exposure) as E, sum((1e-06 + r.Rate*g.Exposure)*(1e-06 + r.Rate*g.Exposure)) as E2
from rdin r join expo_grid g on r.Country = g.Country and r.Cohort = g.Cohort and r.Age = g.Age
where r.Cohort + greatest(least(r.Age, {_LDA}), {_FDA}) <= {_JO}
group by r.Country, r.Sim, r.Chain, r.Iter, r.Cohort, greatest(least(r.Age, {_LDA}), {_FDA})"""

_LL_VIEWS = {
    "rdin": rate_draws_sql(*PF, draws_view=f"(select * from draws where Cohort <= {C.last_insample_cohort})",
                           extra_cols=", Chain, Iter"),
    "eb": _EB_SQL,
}
_LL_DEPS = {"rdin": ["draws"], "eb": ["rdin", "expo_grid"]}


def _ll_select(variant: str) -> str:
    if variant == "poisson":
        return f"""
select e.Country, e.Sim, e.Chain, e.Iter, o.i, {poisson_sql('o.births', 'e.E')} as ll
from eb e join obs o on e.Country = o.Country and e.Cohort = o.Cohort and e.Age = o.Age"""
    if variant == "constant":
        disp, age = "d.Dispersion", str(_FDA)
    else:
        disp = "(case when o.Age_i = 1 or o.Age_i = o.n_ages_obs then d.Dispersion*e.E*e.E/e.E2 else d.Dispersion end)"
        age = "e.Age"
    return f"""
select e.Country, e.Sim, e.Chain, e.Iter, o.i, {nb_sql('o.births', 'e.E', disp)} as ll
from eb e join obs o on e.Country = o.Country and e.Cohort = o.Cohort and e.Age = o.Age
     join dispersion d on d.Country = e.Country and d.Sim = e.Sim and d.Age = {age}"""


def ll_sql(variant: str) -> str:
    views = ["eb", "obs"] + ([] if variant == "poisson" else ["dispersion"])
    return with_views(_ll_select(variant), views, extra=_LL_VIEWS, extra_deps=_LL_DEPS)


def loglik_df(spark, sf_dir, variant: str):
    draws = fx.draws(spark, sf_dir, C)
    disp = None if variant == "poisson" else fx.dispersion(spark, sf_dir, C)
    return lk.loglik(draws, small_observed(spark, sf_dir), small_obs(spark, sf_dir), disp, C,
                     dispersion=variant, param_func=PF)


@register("loglik_variable", "J14 D23 D24 I6 I14", ll_sql("variable"), ["ll"])
def q_loglik_variable(spark, sf_dir):
    return loglik_df(spark, sf_dir, "variable")


@register("loglik_constant", "J14 D23 I6 I14", ll_sql("constant"), ["ll"])
def q_loglik_constant(spark, sf_dir):
    return loglik_df(spark, sf_dir, "constant")


@register("loglik_poisson", "J14 D23 I7 I14", ll_sql("poisson"), ["ll"])
def q_loglik_poisson(spark, sf_dir):
    return loglik_df(spark, sf_dir, "poisson")


# ------------------------------------------------------------------ J16 prior
def _d(x: float) -> str:
    return f"cast('{x!r}' as double)"


def _normal_sql(x: str, mu: float, sd: float) -> str:
    z = f"((({x}) - {_d(mu)})/{_d(sd)})"
    return f"(-0.5e0*{z}*{z} - ln({_d(sd)}) - 0.5e0*ln(2.0e0*pi()))"


def _prior_sql() -> str:
    terms = []
    for p, (mu0, sd0, lower) in lk.INITIAL_PRIORS.items():
        init = _normal_sql(p, mu0, sd0)
        if lower is not None:
            init = f"({init} - {_d(math.log(1.0 - NormalDist(mu0, sd0).cdf(lower)))})"
        step = _normal_sql(f"{p} - lag({p}) over w", 0.0, lk.RW_SCALE * 1.0)
        terms.append(f"(case when row_number() over w = 1 then {init} else {step} end)")
    const = 6 * (-0.5 * (1.0 / lk.SIGMA_PRIOR_SD) ** 2 - math.log(lk.SIGMA_PRIOR_SD) - 0.5 * math.log(2 * math.pi))
    return f"""
, lp AS (select Country, Sim, {' + '.join(terms)} as lp from draws window w as (partition by Country, Sim order by Cohort))
select Country, Sim, sum(lp) + {_d(const)} as log_prior from lp group by Country, Sim"""


@register("log_prior_rw", "J16 E5 I11", with_views("", ["draws"]) + _prior_sql(), ["log_prior"])
def q_log_prior_rw(spark, sf_dir):
    return lk.log_prior(fx.draws(spark, sf_dir, C))


# ------------------------------------------------------------------ K1-K5
_PT_VIEWS = {
    "rdall": rate_draws_sql(*PF),
    "pt": """
select r.Country, r.Sim, r.Cohort, r.Age, r.Comp_1, r.Comp_2, r.Rate, d.Dispersion, cast(r.Cohort + r.Age as int) as Year, o.Births, o.Exposure,
       o.Rate as Obs_rate, r.Rate*o.Exposure as E_births
from rdall r join dispersion d on r.Country = d.Country and r.Sim = d.Sim and r.Age = d.Age
left join rates o on r.Country = o.Country and r.Cohort = o.Cohort and r.Age = o.Age
where not isnan(r.Rate) and not isnan(r.Comp_1) and not isnan(r.Comp_2) and not isnan(d.Dispersion)""",
    "px": f"select row_number() over () as rid, * from pt where Year > {_JO} and Exposure is not null",
    "cd": f"""
select rid, sum(exp({nb_sql('cast(y as double)', 'mu', 'k')})) as cdf
from (select rid, E_births as mu, Dispersion as k, unnest(range(0, cast(floor(Births) as bigint) + 1)) as y from px) u
group by rid""",
    "pxc": "select px.*, cd.cdf from px join cd on px.rid = cd.rid",
}
_PT_DEPS = {"rdall": ["draws"], "pt": ["rdall", "dispersion", "rates"], "px": ["pt"], "cd": ["px"], "pxc": ["px", "cd"]}


def _pt(sql: str, views: list[str]) -> str:
    return with_views(sql, views, extra=_PT_VIEWS, extra_deps=_PT_DEPS)


def predictive(spark, sf_dir, forecast_only: bool = False):
    draws = fx.draws(spark, sf_dir, C)
    disp = fx.dispersion(spark, sf_dir, C)
    obs = small_rates(spark, sf_dir)
    if forecast_only:
        return sc.predictive_table(draws, disp, obs, C, PF, age_filter=sc.forecast_filter(C),
                                   draw_filter=sc.forecast_draws(C))
    return sc.predictive_table(draws, disp, obs, C, PF)


_PT_DOUBLES = ["Comp_1", "Comp_2", "Rate", "Dispersion", "Births", "Exposure", "Obs_rate", "E_births"]


@register("predictive_table", "K1 C6 C7 C15 B16", _pt("select * from pt", ["pt"]), _PT_DOUBLES,
          overrides={"Comp_1": 7, "Comp_2": 7, "Rate": 7, "Obs_rate": 9})
def q_predictive_table(spark, sf_dir):
    return predictive(spark, sf_dir)


_PC_SQL = _PT_VIEWS["pt"].replace("join dispersion d on r.Country = d.Country and r.Sim = d.Sim and r.Age = d.Age",
                                  f"join (select Country, Sim, Dispersion + 1.0 as Dispersion from dispersion where Age = {_FDA}) d "
                                  "on r.Country = d.Country and r.Sim = d.Sim")


@register("predictive_constant", "K1 C6 H7", _pt(_PC_SQL, ["rdall", "dispersion", "rates"]), _PT_DOUBLES,
          overrides={"Comp_1": 7, "Comp_2": 7, "Rate": 7, "Obs_rate": 9})
def q_predictive_constant(spark, sf_dir):
    disp = lk.dispersion_by_age(fx.dispersion_constant(spark, sf_dir, C), C)
    return sc.predictive_table(fx.draws(spark, sf_dir, C), disp, small_rates(spark, sf_dir), C, PF)


@register("dispersion_by_age", "H7",
          with_views(f"""
select Country, Sim, cast(Age as int) as Age, Dispersion from dispersion
union all select Country, Sim, 0, Dispersion + 1.0 from dispersion where Age = {_FDA}""", ["dispersion"]),
          ["Dispersion"])
def q_dispersion_by_age(spark, sf_dir):
    d = fx.dispersion(spark, sf_dir, C)
    k = (F.col("Age") - (_FDA - 1)).cast("string")
    named = d.select("Country", "Sim", F.concat(F.lit("dispersion["), k, F.lit("]")).alias("param"), F.col("Dispersion").alias("value"))
    return lk.dispersion_by_age(named.unionByName(fx.dispersion_constant(spark, sf_dir, C)), C).na.fill(0, ["Age"])  # 0: all ages


@register("dispersion_from_basis", "D26 I14",
          with_views(f"""
, bas AS ({SPLINE_SQL})
select d.Country, d.Sim, b.Age_i, 1.0 + exp(sum(b.value*d.Dispersion/22.0)) as Dispersion
from bas b join dispersion d on d.Country = b.Country and d.Age - {_FDA - 1} = b.k
group by d.Country, d.Sim, b.Age_i""", ["obs", "dispersion"]), ["Dispersion"])
def q_dispersion_from_basis(spark, sf_dir):
    basis = small_basis(spark, sf_dir)
    return lk.dispersion_from_basis(basis, fx.dispersion_coefficients(spark, sf_dir, C))


@register("predictive_rank_exact", "K2",
          _pt("select Country, Age, Cohort, Year, max(Births) as Births, avg(cdf) as Q from pxc "
              "group by Country, Age, Cohort, Year", ["pxc"]),
          ["Births", "Q"])
def q_predictive_rank_exact(spark, sf_dir):
    return sc.predictive_rank(predictive(spark, sf_dir, forecast_only=True), C)


_SCORE_SQL = f"""
, s AS (select Country, Age, Cohort, Year, Sim, {nb_sql('round_even(Births, 0)', 'E_births', 'Dispersion')} as Score
        from pt where Year > {_JO} and Exposure is not null and Exposure <> 0)
, s2 AS (select *, max(Score) over (partition by Country, Age, Cohort, Year) as m from s)
select Country, Age, Cohort, Year, ln(sum(exp(Score - m))) + max(m) - ln(count(*)) as Score, count(*) as n_draws
from s2 group by Country, Age, Cohort, Year"""


@register("log_score", "K4 D8 D9 I6 I8 B13", _pt("", ["pt"]) + _SCORE_SQL, ["Score"])
def q_log_score(spark, sf_dir):
    return sc.cell_log_score(predictive(spark, sf_dir, forecast_only=True), C)


@register("log_score_draws", "K4 I8 B13",
          _pt(f"""
select Country, Age, Cohort, Year, Sim, {nb_sql('round_even(Births, 0)', 'E_births', 'Dispersion')} as Score,
       E_births + E_births*E_births/Dispersion as Var_births
from pt where Year > {_JO} and Exposure is not null and Exposure <> 0""", ["pt"]), ["Score", "Var_births"])
def q_log_score_draws(spark, sf_dir):
    return sc.pointwise_scores(predictive(spark, sf_dir, forecast_only=True), C)


def _rm(x: str) -> str:
    return f"(case when count({x}) < count(*) then null else avg({x}) end)"


_CE_SQL = f"""
, ce0 AS (select Country, Age, Cohort, {_rm('Rate')} as Rate, {_rm('E_births')} as E_births, max(Obs_rate) as Obs_rate,
                 max(Births) as Births, max(Exposure) as Exposure, avg(cdf) as Q from pxc group by Country, Age, Cohort)
, ce AS (select Country, Age, Cohort, Rate, ln(Rate) as Log_rate, E_births, Obs_rate, Births, Exposure, Q,
                Rate - Obs_rate as Bias_rate, abs(Rate - Obs_rate) as AE_rate, abs(Rate - Obs_rate)/Rate as PE_rate,
                (Rate - Obs_rate)*(Rate - Obs_rate) as SE_rate, E_births - Births as Bias_births,
                abs(E_births - Births) as AE_births, abs(E_births - Births)/E_births as PE_births,
                (E_births - Births)*(E_births - Births) as SE_births from ce0)"""
_CE_DOUBLES = ["Rate", "Log_rate", "E_births", "Obs_rate", "Births", "Exposure", "Q", "Bias_rate", "AE_rate",
               "PE_rate", "SE_rate", "Bias_births", "AE_births", "PE_births", "SE_births"]


@register("central_errors", "K5 D3 K2", _pt("", ["pxc"]) + _CE_SQL + "\nselect * from ce", _CE_DOUBLES,
          overrides={"Rate": 9, "Obs_rate": 9, "Bias_rate": 9, "AE_rate": 9, "SE_rate": 12})
def q_central_errors(spark, sf_dir):
    return sc.central_errors(predictive(spark, sf_dir, forecast_only=True), C)


_ES_SQL = f"""
select Country,
  avg(cast(Q >= 0.05 and Q <= 0.95 as double)) as Q_90, avg(cast(Q >= 0.10 and Q <= 0.90 as double)) as Q_80,
  avg(cast(Q >= 0.25 and Q <= 0.75 as double)) as Q_50,
  {_rm('Bias_rate')} as Bias_rate, {_rm('AE_rate')} as AAE_rate, {_rm('PE_rate')} as APE_rate,
  sqrt({_rm('SE_rate')}) as RMSE_rate, {_rm('Bias_births')} as Bias_births, {_rm('AE_births')} as AAE_births,
  {_rm('PE_births')} as APE_births, sqrt({_rm('SE_births')}) as RMSE_births
from ce group by Country"""


@register("error_summary", "K5 D4 D5", _pt("", ["pxc"]) + _CE_SQL + _ES_SQL,
          ["Q_90", "Q_80", "Q_50", "Bias_rate", "AAE_rate", "APE_rate", "RMSE_rate", "Bias_births", "AAE_births",
           "APE_births", "RMSE_births"], overrides={"Bias_rate": 9, "AAE_rate": 9, "RMSE_rate": 9})
def q_error_summary(spark, sf_dir):
    return sc.error_summary(sc.central_errors(predictive(spark, sf_dir, forecast_only=True), C))


def hash_uniform_sql(part: int, seed: int, *keys: str) -> str:
    digest = f"md5('{seed}' || " + " || ".join(f"'|' || {k}" for k in keys) + ")"
    return f"((cast('0x' || substr({digest}, {1 + 13 * part}, 13) as bigint) + 0.5e0)/{float(1 << 52)!r}e0)"


def hash_normal_sql(seed: int, *keys: str) -> str:
    return f"(sqrt(-2.0e0*ln({hash_uniform_sql(0, seed, *keys)}))*cos(2.0e0*pi()*{hash_uniform_sql(1, seed, *keys)}))"


_SAMPLED_SQL = f"""
, cells_u AS (select Country, Sim, Cohort, Age, E_births as mu, Dispersion as k, {hash_uniform_sql(0, C.seed, 'Country', 'Sim', 'Cohort', 'Age')} as u
              from pt where E_births is not null)
, walk AS (select Country, Sim, Cohort, Age, mu, k, u, cast(0 as bigint) as y, exp(k*ln(k/(k + mu))) as p, exp(k*ln(k/(k + mu))) as cum from cells_u
           union all
           select Country, Sim, Cohort, Age, mu, k, u, y + 1, p*(y + k)/(y + 1)*(mu/(k + mu)), cum + p*(y + k)/(y + 1)*(mu/(k + mu))
           from walk where cum < u)
, drawn AS (select Country, Sim, Cohort, Age, max(y) as PP_births from walk group by all)
select pt.Country, pt.Sim, pt.Cohort, pt.Age, E_births, Dispersion, cast(PP_births as double) as PP_births, PP_births/Exposure as PP_rate
from pt left join drawn d on d.Country = pt.Country and d.Sim = pt.Sim and d.Cohort = pt.Cohort and d.Age = pt.Age"""


@register("predictive_sampled", "K3 I9", _pt("", ["pt"]).replace("WITH ", "WITH RECURSIVE ", 1) + _SAMPLED_SQL, ["E_births", "Dispersion", "PP_births", "PP_rate"])
def q_predictive_sampled(spark, sf_dir):
    # a nullable count: as a double at the query's edge
    return sc.predictive_sampled(predictive(spark, sf_dir), C).withColumn("PP_births", F.col("PP_births").cast("double"))


# ------------------------------------------------------------------ I14, U5: from the raw coefficients
_LINKED = {
    "disp_u": "select Country, Sim, k + {0} as Age, 1.0e0 + exp(beta) as Dispersion from log_dispersion".format(_FDA - 1),
    "bas": SPLINE_SQL,
    "disp_s": f"""
select d.Country, d.Sim, b.Age_i + {_FDA - 1} as Age, 1.0e0 + exp(sum(b.value*d.beta)) as Dispersion
from bas b join log_dispersion d on d.Country = b.Country and d.k = b.k group by d.Country, d.Sim, b.Age_i""",
    "disp_c": "select Country, Sim, exp(beta) as Dispersion from log_dispersion where k = 1",
}
_LINKED_DEPS = {"disp_u": ["log_dispersion"], "bas": ["obs"], "disp_s": ["bas", "log_dispersion"], "disp_c": ["log_dispersion"]}


def _linked_ll_sql(view: str, variant: str = "variable") -> str:
    sql = _ll_select(variant).replace("join dispersion d", f"join {view} d")
    if variant == "constant":
        sql = sql.replace(f" and d.Age = {_FDA}", "")
    return with_views(sql, ["eb", "obs", view], extra={**_LL_VIEWS, **_LINKED}, extra_deps={**_LL_DEPS, **_LINKED_DEPS})


def linked(spark, sf_dir, variant: str):
    if variant == "variable":
        return lk.linked_dispersion(fx.dispersion_coefficients(spark, sf_dir, C), C, variant, small_basis(spark, sf_dir))
    coefs = fx.log_dispersion(spark, sf_dir, C)
    return lk.linked_dispersion(coefs.filter("k = 1") if variant == "constant" else coefs, C, variant)


def linked_loglik(spark, sf_dir, variant: str):
    return lk.loglik(fx.draws(spark, sf_dir, C), small_observed(spark, sf_dir), small_obs(spark, sf_dir), linked(spark, sf_dir, variant), C,
                     dispersion=variant, param_func=PF)


@register("loglik_var_unsmooth", "I14 U5 J14", _linked_ll_sql("disp_u"), ["ll"])
def q_loglik_var_unsmooth(spark, sf_dir):
    return linked_loglik(spark, sf_dir, "var_unsmooth")


@register("loglik_spline", "I14 U5 J14 D26", _linked_ll_sql("disp_s"), ["ll"])
def q_loglik_spline(spark, sf_dir):
    return linked_loglik(spark, sf_dir, "variable")


@register("loglik_log_constant", "I14 U5 J14", _linked_ll_sql("disp_c", "constant"), ["ll"])
def q_loglik_log_constant(spark, sf_dir):
    return linked_loglik(spark, sf_dir, "constant")


@register("predictive_spline", "I14 U5 K1 D26", with_views(
    f"select * from pts where Year > {_JO} and Year <= {C.last_year}", ["pts"],
    extra={**_PT_VIEWS, **_LINKED, "pts": _PT_VIEWS["pt"].replace("join dispersion d", "join disp_s d")},
    extra_deps={**_PT_DEPS, **_LINKED_DEPS, "pts": ["rdall", "disp_s", "rates"]}), _PT_DOUBLES,
    overrides={"Comp_1": 7, "Comp_2": 7, "Rate": 7, "Obs_rate": 9})
def q_predictive_spline(spark, sf_dir):
    """The cells that are scored, by the variable variant's coefficients."""
    return sc.predictive_table(fx.draws(spark, sf_dir, C), linked(spark, sf_dir, "variable"), small_rates(spark, sf_dir), C, PF,
                               age_filter=sc.forecast_filter(C), draw_filter=sc.forecast_draws(C))


# ------------------------------------------------------------------ J16 with sigmas, and re-weighting
def _normal_by(x: str, mu: float, sd: str) -> str:
    z = f"((({x}) - {_d(mu)})/({sd}))"
    return f"(-0.5e0*{z}*{z} - ln({sd}) - 0.5e0*ln(2.0e0*pi()))"


def _prior_view(initial: dict | None = None) -> str:
    terms, own = [], []
    for p, (mu0, sd0, lower) in {**lk.INITIAL_PRIORS, **(initial or {})}.items():
        cut = 0.0 if lower is None else math.log(1.0 - NormalDist(mu0, sd0).cdf(lower))
        step = _normal_by(f"{p} - lag({p}) over w", 0.0, f"{_d(lk.RW_SCALE)}*sigma_{p}")
        terms.append(f"(case when row_number() over w = 1 then {_normal_sql(p, mu0, sd0)} - {_d(cut)} else {step} end)")
        own.append(_normal_sql(f"sigma_{p}", 0.0, lk.SIGMA_PRIOR_SD))
    return f"""
select Country, Sim, sum(lp) + max(own) as log_prior
from (select d.Country, d.Sim, {' + '.join(terms)} as lp, {' + '.join(own)} as own
      from draws d join sigmas s on s.Country = d.Country and s.Sim = d.Sim window w as (partition by d.Country, d.Sim order by d.Cohort)) q
group by Country, Sim"""


def _disp_prior_view(variant: str, last: int | None) -> str:
    start_sd, scale, sigma_sd = lk.DISPERSION_PRIORS[variant]
    start = f"{_normal_sql('beta', 0.0, start_sd)} + {_normal_sql('sigma_disp', 0.0, sigma_sd)}"
    step = _normal_by("beta - lag(beta) over w", 0.0, f"{_d(scale)}*sigma_disp")
    return f"""
select Country, Sim, sum(lp) as log_prior
from (select d.Country, d.Sim, case when row_number() over w = 1 then {start} else {step} end as lp
      from log_dispersion d join sigmas s on s.Country = d.Country and s.Sim = d.Sim {'' if last is None else f'where k <= {last}'}
      window w as (partition by d.Country, d.Sim order by d.k)) q group by Country, Sim"""


#: Another prior of the first cohort's level, under which stored draws are weighted.
OTHER_PRIOR = {"CEB": (1.8, 0.2, 0.0)}
_PRIOR_VIEWS = {"lp0": _prior_view(), "lp1": _prior_view(OTHER_PRIOR), "lpv": _disp_prior_view("variable", C.n_dispersion_basis),
                "lpu": _disp_prior_view("var_unsmooth", None)}
_PRIOR_DEPS = {"lp0": ["draws", "sigmas"], "lp1": ["draws", "sigmas"], "lpv": ["log_dispersion", "sigmas"], "lpu": ["log_dispersion", "sigmas"]}


@register("log_prior_sigmas", "J16 E5 I11 U5", with_views("""
select 'constant' as variant, Country, Sim, log_prior from lp0
union all select 'variable', a.Country, a.Sim, a.log_prior + b.log_prior from lp0 a join lpv b on b.Country = a.Country and b.Sim = a.Sim
union all select 'var_unsmooth', a.Country, a.Sim, a.log_prior + b.log_prior from lp0 a join lpu b on b.Country = a.Country and b.Sim = a.Sim""",
                                                          ["lp0", "lpv", "lpu"], extra=_PRIOR_VIEWS, extra_deps=_PRIOR_DEPS), ["log_prior"])
def q_log_prior_sigmas(spark, sf_dir):
    """Log prior of every draw under each dispersion variant, with the draw's own sigmas."""
    sigmas = fx.sigmas(spark, sf_dir, C)
    base = lk.log_prior_given_sigmas(fx.draws(spark, sf_dir, C), sigmas)
    out = base.select(F.lit("constant").alias("variant"), "Country", "Sim", "log_prior")
    for variant, coefs in (("variable", fx.dispersion_coefficients(spark, sf_dir, C)), ("var_unsmooth", fx.log_dispersion(spark, sf_dir, C))):
        more = lk.log_prior_dispersion(coefs, sigmas, variant).withColumnRenamed("log_prior", "more")
        out = out.unionByName(base.join(more, ["Country", "Sim"]).select(
            F.lit(variant).alias("variant"), "Country", "Sim", (F.col("log_prior") + F.col("more")).alias("log_prior")))
    return out


_WEIGHT_PROBS = {"q2_5": 0.025, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q97_5": 0.975}


@register("reweighted_summary", "J16 D15", lambda: with_views(f"""
, lw AS (select a.Country, a.Sim, b.log_prior - a.log_prior as lw from lp0 a join lp1 b on b.Country = a.Country and b.Sim = a.Sim)
, ws AS (select Country, Sim, w/sum(w) over (partition by Country) as weight
         from (select *, exp(lw - max(lw) over (partition by Country)) as w from lw) q)
, rw AS (select d.Country, d.param, d.value, weight, sum(weight) over (partition by d.Country, d.param) as total,
                sum(weight) over (partition by d.Country, d.param order by d.value, d.Sim rows between unbounded preceding and current row) as upto,
                sum(weight*value) over (partition by d.Country, d.param) as m
         from dl d join ws on ws.Country = d.Country and ws.Sim = d.Sim)
select Country, param, max(m) as mean, sqrt(sum(weight*(value - m)*(value - m))) as sd,
       {', '.join(f"min(value) filter (where upto/total >= {p!r}e0) as {n}" for n, p in _WEIGHT_PROBS.items())},
       1.0e0/sum(weight*weight) as n_eff_weights
from rw group by Country, param""", ["lp0", "lp1", "dl"], extra={**_PRIOR_VIEWS, "dl": _draws_long_sql()}, extra_deps={**_PRIOR_DEPS, "dl": ["draws"]}),
          ["mean", "sd", *_WEIGHT_PROBS, "n_eff_weights"])
def q_reweighted_summary(spark, sf_dir):
    """Parameters as they would be under another prior of the level."""
    from ..operators.draws import draws_long

    draws, sigmas = fx.draws(spark, sf_dir, C), fx.sigmas(spark, sf_dir, C)
    weights = lk.reweighting(lk.log_prior_given_sigmas(draws, sigmas), lk.log_prior_given_sigmas(draws, sigmas, initial=OTHER_PRIOR))
    return lk.reweighted_summary(draws_long(draws, C), weights, _WEIGHT_PROBS)


def _draws_long_sql() -> str:
    from .q_draws import DRAWS_LONG_SQL

    return DRAWS_LONG_SQL
