"""Registered queries: report tables (P1-P5), LOOIC grid and run assessment (K6-K9)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..config import FIXTURE as C
from ..config import PARAM_TYPES
from ..operators import comparators as cmp
from ..operators import diagnostics as dg
from ..operators import likelihood as lk
from ..operators import loo
from ..operators import report as rp
from ..operators import scoring as sc
from ..sources import files as fl
from ..sources import fixtures as fx
from . import q_comparators as qc
from . import q_diagnostics as qd
from . import q_scoring as qs
from . import q_sources as qsrc
from .q_diagnostics import long_draws, rhat_sql, _RH_DEPS
from .q_draws import DENS_SQL, DRAWS_LONG_SQL
from .q_prep import emp_rates, small_observed, small_obs, small_rates
from .registry import register
from .views_sql import with_views


# ------------------------------------------------------------------ shared Spark pieces
def mixture_errors(spark, sf_dir):
    return sc.error_summary(sc.central_errors(qs.predictive(spark, sf_dir, forecast_only=True), C))


def rmse_long(spark, sf_dir):
    panel = qc.panel(spark, sf_dir)
    return rp.stack([
        rp.labelled(mixture_errors(spark, sf_dir), "mixture", {"RMSE": "RMSE_rate"}),
        rp.labelled(cmp.freeze_summary(qc.freeze(spark, sf_dir)), "freeze_rate", {"RMSE": "RMSE_rate"}),
        rp.labelled(cmp.slope_rmse(panel, C), "freeze_slope", {"RMSE": "RMSE"}),
        rp.labelled(cmp.interval_scores(fx.posterior_quantiles(spark, sf_dir, C)), "posterior_comparator",
                    {"RMSE": "RMSE"}),
    ])


# ------------------------------------------------------------------ shared SQL pieces
_ALL_VIEWS = {**qs._PT_VIEWS}
_ALL_DEPS = {**qs._PT_DEPS}


def _base(views: list[str]) -> str:
    return with_views("", views, extra=_ALL_VIEWS, extra_deps=_ALL_DEPS)


_RL_TAIL = (qc._FREEZE_CTE + qc._SLOPE_CTE + qs._CE_SQL + f"""
, es AS ({qs._ES_SQL})
, srm AS (select Country, sqrt(avg((ASFR_predictions - ASFR)*(ASFR_predictions - ASFR))) as RMSE
          from clean where abs(Quantile - 0.5e0) < 0.01e0 group by Country)
, fsum AS (select Country, sqrt({qc._rmean('SE_rate')}) as RMSE from frz group by Country)
, isc AS (select Country, sqrt(avg((ASFR_prediction - ASFR)*(ASFR_prediction - ASFR))) as RMSE,
                 avg(cast(ASFR < p95 and ASFR > p5 as double)) as I90, avg(cast(ASFR < p75 and ASFR > p25 as double)) as I50
          from posterior_quantiles where not V_ind group by Country)
, rl AS (select 'mixture' as Method, Country, RMSE_rate as RMSE from es
         union all select 'freeze_rate', Country, RMSE from fsum
         union all select 'freeze_slope', Country, RMSE from srm
         union all select 'posterior_comparator', Country, RMSE from isc)""")
_RL = _base(["pxc", "rates", "posterior_quantiles"]) + _RL_TAIL


_RMSE_COLS = ", ".join(f"max(case when Country = '{c}' then RMSE end) as \"{c}\"" for c in C.countries)


@register("rmse_table", "P1 G1 H4 I15", _RL + f"\nselect Method, {_RMSE_COLS} from rl group by Method", list(C.countries))
def q_rmse_table(spark, sf_dir):
    return rp.pivot_countries(rmse_long(spark, sf_dir), "RMSE", C.countries)


@register("rmse_best", "P2 D29 F3 I21",
          _RL + "\nselect Method, Country, RMSE, round_even(RMSE, 4) as RMSE_rounded, "
                "RMSE = min(RMSE) over (partition by Country) as best from rl",
          ["RMSE", "RMSE_rounded"])
def q_rmse_best(spark, sf_dir):
    return rp.best_per_country(rmse_long(spark, sf_dir), "RMSE", 4)


_COV_TAIL = f"""
, cov AS (select Country, avg(cast(ASFR > Q25 and ASFR < Q75 as double)) as I50,
                 avg(cast(ASFR > Q5 and ASFR < Q95 as double)) as I90
          from (select Country, Year, Age, ASFR, {qc._q(0.05)} as Q5, {qc._q(0.25)} as Q25, {qc._q(0.75)} as Q75,
                       {qc._q(0.95)} as Q95 from clean group by Country, Year, Age, ASFR) w group by Country)
select 'mixture' as Method, Country, '50%' as Interval, Q_50 as Coverage from es
union all select 'mixture', Country, '90%', Q_90 from es
union all select 'freeze_slope', Country, '50%', I50 from cov
union all select 'freeze_slope', Country, '90%', I90 from cov
union all select 'posterior_comparator', Country, '50%', I50 from isc
union all select 'posterior_comparator', Country, '90%', I90 from isc"""


@register("coverage_table", "P3 H9 G1 F1", _RL + _COV_TAIL, ["Coverage"])
def q_coverage_table(spark, sf_dir):
    es = mixture_errors(spark, sf_dir)
    panel = qc.panel(spark, sf_dir)
    slope = cmp.slope_coverage(panel, C).filter(F.col("Interval").isin("I50", "I90"))
    isc = cmp.interval_scores(fx.posterior_quantiles(spark, sf_dir, C))

    def rows(df, method, cols):
        return df.select(F.lit(method).alias("Method"), "Country",
                         F.explode(F.array(*[F.struct(F.lit(lbl).alias("Interval"), F.col(c).alias("Coverage"))
                                             for lbl, c in cols])).alias("r")).select("Method", "Country", "r.*")

    slope_rows = slope.select(F.lit("freeze_slope").alias("Method"), "Country",
                              F.when(F.col("Interval") == "I50", "50%").otherwise("90%").alias("Interval"),
                              F.col("Proportion").alias("Coverage"))
    out = rp.stack([rows(es, "mixture", [("50%", "Q_50"), ("90%", "Q_90")]), slope_rows,
                    rows(isc, "posterior_comparator", [("50%", "I50"), ("90%", "I90")])])
    return out.orderBy("Interval", "Method", "Country")  # presentation order


# ------------------------------------------------------------------ P4 LOOIC grid (9 models, one job)
PAIRS = [(a, b) for a in PARAM_TYPES for b in PARAM_TYPES]


def _dens_case(name_col: str, x: str, loc: str, s: str) -> str:
    whens = " ".join(f"when {name_col} = '{n}' then {DENS_SQL[n](x, loc, s)}" for n in PARAM_TYPES)
    return f"(case {whens} end)"


def _rd9_sql() -> str:
    x = "(cast(a.range as double) - 0.5e0)"
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)
    amin = float(C.minimum_age)
    return f"""
select Country, p1, p2, Sim, Chain, Iter, Cohort, cast(a.range + {C.minimum_age - 1} as int) as Age,
       w1*{_dens_case('p1', x, 'l1', 'sd_1')} + w2*{_dens_case('p2', x, 'l2', 'sd_2')} as Rate
from (select d.*, m.p1, m.p2, CEB*(1.0e0/(1.0e0 + exp(-logit_mixture))) as w1,
             CEB*(1.0e0 - 1.0e0/(1.0e0 + exp(-logit_mixture))) as w2,
             0.5e0*(mode_age_sum - mode_age_gap) - {amin!r}e0 as l1,
             0.5e0*(mode_age_sum + mode_age_gap) - {amin!r}e0 as l2
      from draws d cross join (values {pairs}) m(p1, p2) where d.Cohort <= {C.last_insample_cohort}) d,
     range(1, {C.n_ages + 1}) a"""


_LDA, _FDA, _JO = C.last_data_age, C.first_data_age, C.jump_off
_GRID_VIEWS = {
    "rd9": _rd9_sql(),
    "eb9": f"""
select r.Country, r.p1, r.p2, r.Sim, r.Cohort, greatest(least(r.Age, {_LDA}), {_FDA}) as Age,
       sum(1e-06 + r.Rate*g.Exposure) as E, sum((1e-06 + r.Rate*g.Exposure)*(1e-06 + r.Rate*g.Exposure)) as E2
from rd9 r join expo_grid g on r.Country = g.Country and r.Cohort = g.Cohort and r.Age = g.Age
where r.Cohort + greatest(least(r.Age, {_LDA}), {_FDA}) <= {_JO}
group by r.Country, r.p1, r.p2, r.Sim, r.Cohort, greatest(least(r.Age, {_LDA}), {_FDA})""",
    "ll9": f"""
select e.Country, e.p1, e.p2, e.Sim, 1 + cast(floor(e.Sim/{C.iters_per_chain}) as int) as Chain, o.i,
       {qs.nb_sql('o.births', 'e.E', '(case when o.Age_i = 1 or o.Age_i = o.n_ages_obs then d.Dispersion*e.E*e.E/e.E2 else d.Dispersion end)')} as ll
from eb9 e join obs o on e.Country = o.Country and e.Cohort = o.Cohort and e.Age = o.Age
     join dispersion d on d.Country = e.Country and d.Sim = e.Sim and d.Age = e.Age""",
}
_GRID_DEPS = {"rd9": ["draws"], "eb9": ["rd9", "expo_grid"], "ll9": ["eb9", "obs", "dispersion"]}


def loglik_by_model(spark, sf_dir):
    return lk.loglik(fx.draws(spark, sf_dir, C), small_observed(spark, sf_dir), small_obs(spark, sf_dir),
                     fx.dispersion(spark, sf_dir, C), C, "variable", pairs=PAIRS)


def looic_by_model(spark, sf_dir):
    """LOOIC of every run as the reports print it: PSIS, corrected by refits (M11); NULL for a run with divergences."""
    from .q_loo import corrected_by_model

    return corrected_by_model(spark, sf_dir).select("Country", "p1", "p2", F.col("looic_corrected").alias("looic"), "looic_se")


def _looic_sql(sql: str) -> str:
    from .q_loo import _LOOIC, _LOOIC_DEPS, _p

    lg9 = "select Country, p1, p2, looic_corrected as looic, looic_se from corrected"
    return _p(sql, ["lg9"], {**_LOOIC, "lg9": lg9}, {**_LOOIC_DEPS, "lg9": ["corrected"]})


_GRID_SQL = """
select Country, first, gamma, weibull, hadwiger from (
  pivot (select Country, replace(p1, '_density', '') as first, replace(p2, '_density', '') as second, looic from lg9)
  on second in ('gamma', 'weibull', 'hadwiger') using first(looic) group by Country, first)"""


@register("looic_grid", "P4 M12 I4 I16 I17",
          lambda: _looic_sql(_GRID_SQL), ["gamma", "weibull", "hadwiger"])
def q_looic_grid(spark, sf_dir):
    return rp.looic_grid(looic_by_model(spark, sf_dir))


# ------------------------------------------------------------------ P5 cohort profiles
PROFILE_COHORTS = (1950, 1960, 1970, 1980, 1990)
_PC = ", ".join(str(c) for c in PROFILE_COHORTS)


@register("cohort_profiles", "P5 G1 C11 D14 B17",
          _base(["rdall", "rates"]) + f"""
select *, case when Cohort + Age <= {C.jump_off} then 'observed' else 'out_of_sample' end as Period from (
select 'observed' as Source, Country, cast(Cohort as bigint) as Cohort, Age, Rate from rates where Cohort in ({_PC})
union all
select 'model_median', Country, Cohort, Age, quantile_cont(Rate, 0.5e0) from rdall where Cohort in ({_PC})
group by Country, Cohort, Age) u""", ["Rate"], overrides={"Rate": 9})
def q_cohort_profiles(spark, sf_dir):
    obs = emp_rates(spark, sf_dir).filter(F.col("Cohort").isin(*PROFILE_COHORTS)).select(
        F.lit("observed").alias("Source"), "Country", F.col("Cohort").cast("bigint").alias("Cohort"), "Age", "Rate")
    draws = fx.draws(spark, sf_dir, C).filter(F.col("Cohort").isin(*PROFILE_COHORTS))
    from ..operators.draws import rate_draws

    med = rate_draws(draws, C, qs.PF).groupBy("Country", "Cohort", "Age").agg(
        F.percentile("Rate", 0.5).alias("Rate")).select(F.lit("model_median").alias("Source"), "Country", "Cohort",
                                                         "Age", "Rate")
    out = rp.stack([obs, med])
    # Observed / out-of-sample label from the configured jump-off (quirk X16)
    return out.withColumn("Period", F.when(F.col("Cohort") + F.col("Age") <= C.jump_off, "observed")
                          .otherwise("out_of_sample"))


# ------------------------------------------------------------------ K6/K7 run assessment, K8/K9 collation
#: What a run carries about itself: plain strings, as given by whoever starts it.
RUN_INFO = {"version_time": "2019-03-10 12:00:00", "version_hash": "0123456789abcdef0123456789abcdef01234567", "run_date": "20190310_120000"}


def run_assessment(spark, sf_dir):
    """K6 + K7: one row per run (here: per country for the gamma/Weibull variable model)."""
    # the forecast predictive table feeds both the errors and the score: materialise it once
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    pred = qs.predictive(spark, sf_dir, forecast_only=True).checkpoint(eager=True)
    es = sc.error_summary(sc.central_errors(pred, C))
    score = sc.cell_log_score(pred, C).groupBy("Country").agg(F.sum("Score").alias("total_score"))
    rh = dg.split_rhat(long_draws(spark, sf_dir), C)
    flags = dg.sampler_flags(fx.sampler_params(spark, sf_dir, C), rh, C)
    energy = dg.energy_flags(fx.sampler_params(spark, sf_dir, C)).groupBy("Country").agg(
        F.min(F.col("energy_good").cast("int")).cast("boolean").alias("energy_good"))
    ll = qs.loglik_df(spark, sf_dir, "variable")
    looic = loo.loo_summary(loo.psis_loo(ll), "elpd_loo", k_col="pareto_k", k_threshold=C.pareto_k_threshold).select(
        "Country", "looic", "looic_se", "n_high_pareto_k")
    long = long_draws(spark, sf_dir)
    neff = dg.effective_sample_size(long).groupBy("Country").agg(F.min("ess").alias("min_neff"))
    minutes = dg.run_time(fl.read_elapsed(spark, qsrc.sampler_files(spark, sf_dir)))
    p1, p2 = qs.PF
    base = flags.select(
        F.lit(C.model).alias("model_name"), F.col("Country").alias("country"), F.lit(C.time_dimension).alias("axis"),
        F.lit(C.dispersion).alias("dispersion"), F.lit(2).alias("n_components"), F.lit(True).alias("mixed_components"),
        F.lit(p1).alias("param_type_1"), F.lit(p2).alias("param_type_2"), "converged_rhat", "n_large_rhat",
        "treedepth_good", "n_max_treedepth", "n_div", F.lit(C.T_holdback).alias("n_holdback"),
        F.lit(C.jump_off).alias("forecast_jump_off"), F.lit(C.last_year).alias("last_data_year"),
        *[F.lit(RUN_INFO[k]).alias(k) for k in ("version_time", "version_hash", "run_date")],
        F.substring(F.lit(RUN_INFO["version_hash"]), 1, 7).alias("version_short_hash"),
    )
    # quirk X23: Spark names are case-insensitive, so the run key is joined as ``country``
    def key(df):
        return df.withColumnRenamed("Country", "country")

    return base.join(key(energy), "country").join(key(es), "country").join(key(score), "country").join(
        key(looic), "country").join(key(neff), "country").join(key(minutes), "country")


_RA_DOUBLES = ["Q_90", "Q_80", "Q_50", "Bias_rate", "AAE_rate", "APE_rate", "RMSE_rate", "Bias_births", "AAE_births",
               "APE_births", "RMSE_births", "total_score", "looic", "looic_se", "min_neff", "runtime_min"]


def _ra_sql() -> str:
    rh = rhat_sql(dg.all_chains(C))
    extra = {**_ALL_VIEWS, **qs._LL_VIEWS, "dl": DRAWS_LONG_SQL, **rh, "ll": qs._ll_select("variable")}
    deps = {**_ALL_DEPS, **qs._LL_DEPS, **_RH_DEPS, "ll": ["eb", "obs", "dispersion"]}
    from .psis_sql import ess_views, psis_views

    for views, needs in (psis_views("pl", "Country, i", "ll"), ess_views("pe", "Country, param", "dl", "value")):
        extra.update(views)
        deps.update(needs)
    extra["ela"] = qsrc.ELAPSED_SQL
    deps["ela"] = ["sampler_params"]
    head = with_views("", ["pxc", "rh", "ll", "sampler_params", "pt", "pl", "pe_e", "ela"], extra=extra, extra_deps=deps)
    return head + qs._CE_SQL + f"""
, es AS ({qs._ES_SQL})
, s AS (select Country, Age, Cohort, Year, Sim, {qs.nb_sql('round_even(Births, 0)', 'E_births', 'Dispersion')} as Score
        from pt where Year > {C.jump_off} and Exposure is not null and Exposure <> 0)
, cs AS (select Country, ln(sum(exp(Score - m))) + max(m) - ln(count(*)) as Score
         from (select *, max(Score) over (partition by Country, Age, Cohort, Year) as m from s) x
         group by Country, Age, Cohort, Year)
, ts AS (select Country, sum(Score) as total_score from cs group by Country)
, sp AS (select Country, cast(sum(divergent__) as bigint) as n_div,
                count(*) filter (where treedepth__ = {C.max_treedepth}) as n_max_treedepth from sampler_params group by Country)
, rv AS (select Country, max(rhat) as max_rhat, count(*) filter (where rhat > {C.rhat_threshold}) as n_large_rhat
         from rh group by Country)
, en AS (select Country, min(cast(num/den >= 0.2 as int)) = 1 as energy_good
         from (select Country, Chain, sum(de*de) as num, var_samp(energy__)*(count(*) - 1) as den
               from (select Country, Chain, energy__,
                            energy__ - lag(energy__) over (partition by Country, Chain order by Iter) as de
                     from sampler_params) a group by Country, Chain) b group by Country)
, lo AS (select Country, -2.0*sum(elpd_loo) as looic, 2.0*sqrt(count(elpd_loo)*var_samp(elpd_loo)) as looic_se,
                count(*) filter (pareto_k > {C.pareto_k_threshold}) as n_high_pareto_k from pl group by Country)
, ne AS (select Country, min(ess) as min_neff from pe_e group by Country)
, rt AS (select Country, max(warmup + sampling)/60.0e0 as runtime_min from ela group by Country)
, ra AS (select '{C.model}' as model_name, sp.Country as country, '{C.time_dimension}' as axis,
                '{C.dispersion}' as dispersion, 2 as n_components, true as mixed_components,
                '{qs.PF[0]}' as param_type_1, '{qs.PF[1]}' as param_type_2,
                rv.max_rhat < {C.rhat_threshold} as converged_rhat, rv.n_large_rhat,
                sp.n_max_treedepth = 0 as treedepth_good, sp.n_max_treedepth, sp.n_div,
                {C.T_holdback} as n_holdback, {C.jump_off} as forecast_jump_off, {C.last_year} as last_data_year,
                en.energy_good, es.Q_90, es.Q_80, es.Q_50, es.Bias_rate, es.AAE_rate, es.APE_rate, es.RMSE_rate,
                es.Bias_births, es.AAE_births, es.APE_births, es.RMSE_births, ts.total_score, lo.looic, lo.looic_se, lo.n_high_pareto_k,
                {', '.join(f"'{v}' as {k}" for k, v in RUN_INFO.items())}, '{RUN_INFO["version_hash"][:7]}' as version_short_hash,
                ne.min_neff, rt.runtime_min
         from sp join rv on sp.Country = rv.Country join en on sp.Country = en.Country
              join es on sp.Country = es.Country join ts on sp.Country = ts.Country join lo on sp.Country = lo.Country
              join ne on ne.Country = sp.Country join rt on rt.Country = sp.Country)"""


@register("run_assessment", "K6 K7 D16-D18 L2 L3 L11 K4 K5 M1 I19", _ra_sql() + "\nselect * from ra", _RA_DOUBLES,
          overrides={"Bias_rate": 9, "AAE_rate": 9, "RMSE_rate": 9})
def q_run_assessment(spark, sf_dir):
    return run_assessment(spark, sf_dir)


COLLATE_COLS = ["country", "param_type_1", "param_type_2", "RMSE_rate", "Q_90", "Q_50", "total_score"]


def reassess_after_discard(spark, sf_dir, runs):
    """K9: for the variable-dispersion runs whose R-hat failed, leave out the chains that the chain decision discards
    and recompute errors and score from the remaining draws; a run without a decision has no row."""
    todo = runs.filter(~F.col("converged_rhat") & (F.col("dispersion") == "variable"))
    todo = todo.select(F.col("country").alias("Country")).join(qd.choices(spark, sf_dir).filter("discard is not null"), "Country")
    todo = F.broadcast(todo.select("Country", "discard").filter(F.col("Country").isin(*C.countries)))  # a row per configured country
    draws = fx.draws(spark, sf_dir, C).join(todo, "Country").filter(~dg.has_chain(F.col("discard"), F.col("Chain"))).drop("discard")
    pred = sc.predictive_table(draws, fx.dispersion(spark, sf_dir, C), small_rates(spark, sf_dir), C, qs.PF,
                               age_filter=sc.forecast_filter(C), draw_filter=sc.forecast_draws(C))
    es = sc.error_summary(sc.central_errors(pred, C))
    score = sc.cell_log_score(pred, C).groupBy("Country").agg(F.sum("Score").alias("total_score"))
    return es.join(score, "Country").select(
        F.col("Country").alias("country"), F.lit(qs.PF[0]).alias("param_type_1"), F.lit(qs.PF[1]).alias("param_type_2"),
        "RMSE_rate", "Q_90", "Q_50", "total_score")


def _collate_sql() -> str:
    # the decision's R-hat views under names of their own, beside those of the assessment
    other = {k: f"{k}_s" for k in ("subs", "rx", "rx2", "seg", "seg2", "rh")}

    def renamed(sql: str) -> str:
        for k, v in other.items():
            sql = re.sub(rf"\b{k}\b", v, sql)
        return sql

    views = {other[k]: renamed(v) for k, v in rhat_sql(qd.CHOICE_SUBSETS).items()}
    choice = "".join(f"\n, {k} AS ({v})" for k, v in views.items()) + renamed(qd.choice_ctes())
    kept = f"""
, pk AS (select p.* from pt p join cc on cc.Country = p.Country
         where discard is not null and (discard // (1 << (cast(floor(p.Sim/{C.iters_per_chain}) as int)))::int) % 2 = 0)
, pxk AS (select p.* from pxc p join cc on cc.Country = p.Country
          where discard is not null and (discard // (1 << (cast(floor(p.Sim/{C.iters_per_chain}) as int)))::int) % 2 = 0)"""
    ce = qs._CE_SQL.replace("pxc", "pxk").replace("ce0", "cek0").replace(", ce AS", ", cek AS")
    es = qs._ES_SQL.replace("from ce group", "from cek group")
    return _ra_sql() + choice + kept + ce + f"""
, esk AS ({es})
, sk AS (select Country, Age, Cohort, Year, Sim, {qs.nb_sql('round_even(Births, 0)', 'E_births', 'Dispersion')} as Score
         from pk where Year > {C.jump_off} and Exposure is not null and Exposure <> 0)
, tsk AS (select Country, sum(Score) as total_score from (
            select Country, ln(sum(exp(Score - m))) + max(m) - ln(count(*)) as Score
            from (select *, max(Score) over (partition by Country, Age, Cohort, Year) as m from sk) x
            group by Country, Age, Cohort, Year) y group by Country)
select distinct {', '.join(COLLATE_COLS)} from ra where n_div = 0 and dispersion = 'variable' and converged_rhat
union all
select ra.country, param_type_1, param_type_2, esk.RMSE_rate, esk.Q_90, esk.Q_50, tsk.total_score
from ra join esk on esk.Country = ra.country join tsk on tsk.Country = ra.country
where not converged_rhat and dispersion = 'variable'"""


@register("assessment_collate", "K8 K9 G1 G3 C12 L4 L6", _collate_sql(), ["RMSE_rate", "Q_90", "Q_50", "total_score"],
          overrides={"RMSE_rate": 9})
def q_assessment_collate(spark, sf_dir):
    runs = run_assessment(spark, sf_dir).checkpoint(eager=True)  # a row per run; both branches read it
    kept = runs.dropDuplicates().filter((F.col("n_div") == 0) & (F.col("dispersion") == "variable")
                                        & F.col("converged_rhat")).select(*COLLATE_COLS)
    return rp.stack([kept, reassess_after_discard(spark, sf_dir, runs)])


_REPORT_SQL = """
select Country, replace(p1, '_density', '') || '_density' as param_type_1,
       replace(p2, '_density', '') || '_density' as param_type_2,
       upper(substr(replace(p1, '_density', ''), 1, 1)) || substr(replace(p1, '_density', ''), 2) || ' / ' ||
       upper(substr(replace(p2, '_density', ''), 1, 1)) || substr(replace(p2, '_density', ''), 2) as Components,
       looic, looic_se
from lg9"""


@register("looic_report", "M12 I16 I17 I18 G1",
          lambda: _looic_sql(_REPORT_SQL), ["looic", "looic_se"])
def q_looic_report(spark, sf_dir):
    lb = looic_by_model(spark, sf_dir)
    s1, s2 = rp.short_density(F.col("p1")), rp.short_density(F.col("p2"))
    return lb.select(
        "Country",
        F.concat(s1, F.lit("_density")).alias("param_type_1"),  # I18: suffix as the LKO runs expect
        F.concat(s2, F.lit("_density")).alias("param_type_2"),
        rp.components_label(F.col("p1"), F.col("p2")).alias("Components"),
        "looic", "looic_se",
    )
