"""Registered queries: LOO and leave-k-out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FIXTURE as C
from ..operators import diagnostics as dg
from ..operators import folds, loo
from ..operators import likelihood as lk
from ..operators.small import small_table, stored_table
from ..sources import fixtures as fx
from . import q_diagnostics as qd
from .psis_sql import psis_views
from .q_prep import small_obs
from .q_scoring import _LL_DEPS, _LL_VIEWS, _ll_select, loglik_df
from .registry import register
from .views_sql import with_views

_LLV = {**_LL_VIEWS, "ll": _ll_select("variable")}
_LLD = {**_LL_DEPS, "ll": ["eb", "obs", "dispersion"]}

_ISL = """
select Country, i, ln(sum(exp(ll - m1))) + max(m1) - ln(count(*)) as lpd,
       -(ln(sum(exp(-ll - m2))) + max(m2) - ln(count(*))) as elpd_is,
       (ln(sum(exp(ll - m1))) + max(m1) - ln(count(*))) + (ln(sum(exp(-ll - m2))) + max(m2) - ln(count(*))) as p_is,
       count(*) as n_draws
from (select *, max(ll) over (partition by Country, i) as m1, max(-ll) over (partition by Country, i) as m2 from ll) x
group by Country, i"""


def _v(sql: str, views: list[str], extra=None, deps=None) -> str:
    return with_views(sql, views, extra={**_LLV, **(extra or {})}, extra_deps={**_LLD, **(deps or {})})


def ll_variable(spark, sf_dir):
    return loglik_df(spark, sf_dir, "variable")


@register("is_loo", "M2 D8", _v(_ISL, ["ll"]), ["lpd", "elpd_is", "p_is"])
def q_is_loo(spark, sf_dir):
    return loo.is_loo(ll_variable(spark, sf_dir))


#: A run of the PSIS chain: a country and a pair of component densities.
RUN = ("Country", "p1", "p2")


def chains_in_use(spark, sf_dir):
    """M3 of every country, made once per session."""
    def build():
        verdicts = qd.verdicts_once(spark, sf_dir)
        flags = fx.sampler_params(spark, sf_dir, C).groupBy("Country").agg(F.sum("divergent__").alias("n_div"))
        return dg.chains_in_use(verdicts, flags, qd.choices(spark, sf_dir), C)

    return small_table(spark, ("chains_in_use", sf_dir), build, broadcast=False)


def ll_by_model(spark, sf_dir):
    """Pointwise log likelihood of every run under the chains in use, written once per session: PSIS, refits and kept sums
    read it."""
    from .q_reports import loglik_by_model

    return stored_table(spark, ("ll_by_model", sf_dir), lambda: dg.without_discarded(loglik_by_model(spark, sf_dir), chains_in_use(spark, sf_dir)),
                        "Country")


def psis_by_model(spark, sf_dir):
    """M1 + M4: pointwise PSIS of every run, written once per session."""
    return stored_table(spark, ("psis", sf_dir), lambda: loo.psis_loo(ll_by_model(spark, sf_dir), RUN), "Country")


def high_k_points(spark, sf_dir):
    """M6: the observations to refit, of every run."""
    d = loo.loo_diagnostics(psis_by_model(spark, sf_dir), small_obs(spark, sf_dir), C, RUN)
    return d.filter("refit").select(*RUN, "i")


_KEPT = f"l.Chain is not null and (u.discard = 0 or not ({qd.has_chain_sql('u.discard', 'l.Chain')}))"


def _psis_views():
    """psis: pointwise PSIS of every run from the chains in use; points: with each observation's place."""
    from .q_reports import _GRID_DEPS, _GRID_VIEWS

    every = dg.chain_bits(C)
    found, deps = psis_views("psis", "Country, p1, p2, i", "ll9k")
    choice, choice_deps = qd.choice_views()
    rhat = qd.rhat_sql(dg.all_chains(C) + qd.CHOICE_SUBSETS)
    views = {
        **_GRID_VIEWS, **_LLV, "dl": qd.DRAWS_LONG_SQL, **rhat, **choice,
        "used": f"""
select Country, n_div = 0 and (ok or told) as loo_eligible, case when not ok and told then discard else 0 end as discard
from (select v.Country, v.c as ok, d.n_div, cc.discard, cc.discard is not null and cc.discard <> {every} as told
      from v0 v join (select Country, sum(divergent__) as n_div from sampler_params group by Country) d on d.Country = v.Country
           left join cc on cc.Country = v.Country where v.subset = 'all') q""",
        "ll9k": f"select l.* from ll9 l join used u on u.Country = l.Country where {_KEPT}",
        **found,
        "points": f"""
select p.Country, p.p1, p.p2, p.i, o.Age, o.Cohort, o.Time, o.Age_i, p.pareto_k, p.pareto_k > {C.pareto_k_threshold} as refit
from psis p join obs o on o.Country = p.Country and o.i = p.i""",
    }
    return views, {**_GRID_DEPS, **_LLD, **qd._RH_DEPS, **choice_deps, "used": ["v0", "cc", "sampler_params"], "ll9k": ["ll9", "used"], **deps,
                   "points": ["psis", "obs"]}


def _p(sql: str, views: list[str], extra=None, deps=None) -> str:
    own, own_deps = _psis_views()
    return with_views(sql, views, extra={**own, **(extra or {})}, extra_deps={**own_deps, **(deps or {})})


@register("psis_loo", "M1 M4 L2", lambda: _p("select * from psis", ["psis"]), ["elpd_loo", "p_loo", "looic", "pareto_k", "r_eff"])
def q_psis_loo(spark, sf_dir):
    return psis_by_model(spark, sf_dir)


_LOOIC = {
    "summed": f"""
select p.Country, p.p1, p.p2, any_value(e.loo_eligible) as ok, count(*) as n_obs, count(*) filter (pareto_k > {C.pareto_k_threshold}) as n_high,
       sum(elpd_loo) as elpd, sqrt(count(*)*var_samp(elpd_loo)) as se, sum(p_loo) as p_loo,
       -2.0e0*sum(case when pareto_k > {C.pareto_k_threshold} then elpd_loo + p_loo else elpd_loo end) as refitted,
       2.0e0*sqrt(count(*)*var_samp(case when pareto_k > {C.pareto_k_threshold} then elpd_loo + p_loo else elpd_loo end)) as se_refitted
from psis p join used e on e.Country = p.Country group by p.Country, p.p1, p.p2""",
    "corrected": """
select Country, p1, p2, ok as loo_eligible, n_obs, n_high as n_high_pareto_k, n_high as n_refit, case when ok then elpd end as elpd_loo,
       case when ok then se end as elpd_se, case when ok then p_loo end as p_loo, case when ok then -2.0e0*elpd end as looic,
       case when ok then 2.0e0*se end as looic_se, case when ok and n_high = 0 then -2.0e0*elpd when ok then refitted end as looic_corrected,
       case when ok then se_refitted end as looic_se_recomputed
from summed""",
}
_LOOIC_DEPS = {"summed": ["psis", "used"], "corrected": ["summed"]}


def corrected_by_model(spark, sf_dir):
    """M11 of every run, made once per session: the reports print it."""
    def build():
        refit = loo.lpd_points(ll_by_model(spark, sf_dir), high_k_points(spark, sf_dir), RUN)
        return loo.corrected_psis(psis_by_model(spark, sf_dir), refit, chains_in_use(spark, sf_dir).drop("discard"), C, RUN)

    return small_table(spark, ("corrected", sf_dir), build, broadcast=False)


_SUMMARY = ["elpd_loo", "elpd_se", "p_loo", "looic", "looic_se", "looic_corrected", "looic_se_recomputed"]


@register("psis_summary", "M1 M3 M4 M11 C18 C19 D27 D28", lambda: _p("select * from corrected", ["corrected"], _LOOIC, _LOOIC_DEPS), _SUMMARY)
def q_psis_summary(spark, sf_dir):
    return corrected_by_model(spark, sf_dir)


@register("loo_diagnostics", "M5 M6 D28", lambda: _p("select Country, p1, p2, i, Age, Cohort, pareto_k, refit from points", ["points"]), ["pareto_k"])
def q_loo_diagnostics(spark, sf_dir):
    return loo.loo_diagnostics(psis_by_model(spark, sf_dir), small_obs(spark, sf_dir), C, RUN)


def high_k_obs(spark, sf_dir):
    return high_k_points(spark, sf_dir).join(small_obs(spark, sf_dir), ["Country", "i"])


_H = folds.PRIME
_FOLDS = {
    "high": "select * from points where refit",
    "sized": "select *, count(*) over (partition by Country, p1, p2) as n from high",
    "dealt": f"""
select Country, p1, p2, i, Time, Age_i, split,
       cast((row_number() over (partition by Country, p1, p2, split order by h, i) - 1) % {folds.N_FOLDS} + 1 as int) as fold
from (select *, case when split = 0 then 0 else ((cast(i as bigint)*(((split*69621 + 48271)*40014) % {_H})) % {_H})*(i + split) % {_H} end as h
      from (select *, unnest(range(0, {folds.N_SPLITS})) as split from sized where n > {folds.N_FOLDS}) a) b""",
    "scored": """
select a.Country, a.p1, a.p2, a.split, min((a.Time - b.Time)*(a.Time - b.Time) + (a.Age_i - b.Age_i)*(a.Age_i - b.Age_i)) as d2
from dealt a join dealt b on b.Country = a.Country and b.p1 = a.p1 and b.p2 = a.p2 and b.split = a.split and b.fold = a.fold and a.i < b.i
group by all""",
    "chosen": "select Country, p1, p2, d2, split from scored qualify row_number() over (partition by Country, p1, p2 order by d2 desc, split) = 1",
    "folded": f"""
select d.Country, d.p1, d.p2, d.i, d.fold, sqrt(cast(c.d2 as double)) as min_within_dist
from dealt d join chosen c on c.Country = d.Country and c.p1 = d.p1 and c.p2 = d.p2 and c.split = d.split
union all
select Country, p1, p2, i, cast(row_number() over (partition by Country, p1, p2 order by i) as int), null from sized where n <= {folds.N_FOLDS}""",
    "near": """
select a.Country, a.p1, a.p2, a.i, min(sqrt(cast((a.Time - b.Time)*(a.Time - b.Time) + (a.Age_i - b.Age_i)*(a.Age_i - b.Age_i) as double))) as nn_dist
from high a left join high b on b.Country = a.Country and b.p1 = a.p1 and b.p2 = a.p2 and b.i <> a.i group by all""",
}
_FOLD_DEPS = {"high": ["points"], "sized": ["high"], "dealt": ["sized"], "scored": ["dealt"], "chosen": ["scored"], "folded": ["dealt", "chosen", "sized"],
              "near": ["high"]}


def folds_by_model(spark, sf_dir):
    """M7 of every run, made once per session."""
    return small_table(spark, ("folds", sf_dir), lambda: folds.best_folds(high_k_obs(spark, sf_dir), RUN), broadcast=False)


@register("lko_folds", "M7 C17", lambda: _p(f"""select f.*, coalesce(f.min_within_dist < {folds.NEAR}, false) as too_near, n.nn_dist
from folded f join near n on n.Country = f.Country and n.p1 = f.p1 and n.p2 = f.p2 and n.i = f.i""", ["folded", "near"], _FOLDS, _FOLD_DEPS),
          ["min_within_dist", "nn_dist"])
def q_lko_folds(spark, sf_dir):
    return folds_by_model(spark, sf_dir).join(folds.nearest(high_k_obs(spark, sf_dir), RUN), [*RUN, "i"])


def _model_number() -> str:
    from .q_reports import PAIRS

    return " ".join(f"when p1 = '{a}' and p2 = '{b}' then 'model{k}'" for k, (a, b) in enumerate(sorted(PAIRS), 1))


@register("lko_runs", "M8 D30 H13 I24", lambda: _p(f"""
select case {_model_number()} end as Model, Country, p1, p2, fold, string_agg(cast(i as varchar), '_' order by i) as inds,
       cast(count(*) as int) as n_points, 'variable' as dispersion from folded group by Country, p1, p2, fold""", ["folded"], _FOLDS, _FOLD_DEPS))
def q_lko_runs(spark, sf_dir):
    return loo.lko_runs(folds_by_model(spark, sf_dir), F.expr(f"case {_model_number()} end"), keys=RUN)


@register("lko_distance", "C17", lambda: _p("select * from near", ["near"], _FOLDS, _FOLD_DEPS), ["nn_dist"])
def q_lko_distance(spark, sf_dir):
    return folds.nearest(high_k_obs(spark, sf_dir), RUN)


@register("loglik_keep", "J15 C12 M9 H13", lambda: _p("""
select l.Country, l.p1, l.p2, r.fold, l.Sim, sum(l.ll) as ll_keep, count(*) as n_keep
from ll9k l join (select distinct Country, p1, p2, fold from folded) r on r.Country = l.Country and r.p1 = l.p1 and r.p2 = l.p2
     left join folded d on d.Country = l.Country and d.p1 = l.p1 and d.p2 = l.p2 and d.i = l.i and d.fold = r.fold
where d.i is null group by l.Country, l.p1, l.p2, r.fold, l.Sim""", ["ll9k", "folded"], _FOLDS, _FOLD_DEPS), ["ll_keep"])
def q_loglik_keep(spark, sf_dir):
    runs = loo.lko_runs(folds_by_model(spark, sf_dir), keys=RUN)
    left_out = lk.drop_sets(runs, (*RUN, "fold"))
    return lk.loglik_keep(ll_by_model(spark, sf_dir), left_out, RUN, folds.N_FOLDS)


@register("refit_lpd", "M10 D10", lambda: _p("""
select f.Country, f.p1, f.p2, f.fold, f.i as ll_ind, p.elpd_loo + p.p_loo as lpd
from folded f join psis p on p.Country = f.Country and p.p1 = f.p1 and p.p2 = f.p2 and p.i = f.i""", ["folded", "psis"], _FOLDS, _FOLD_DEPS), ["lpd"])
def q_refit_lpd(spark, sf_dir):
    runs = folds_by_model(spark, sf_dir).select(*RUN, "fold", "i")
    return loo.lpd_points(ll_by_model(spark, sf_dir), runs, RUN).join(runs.withColumnRenamed("i", "ll_ind"), [*RUN, "ll_ind"]).select(
        *RUN, "fold", "ll_ind", "lpd")


@register("corrected_looic", "M11 M12 C18 C19 D27 X9", lambda: _p("""
select Country, p1, p2, n_refit, looic_corrected as looic, looic_se, looic_se_recomputed, looic as looic_uncorrected from corrected""",
                                                              ["corrected"], _LOOIC, _LOOIC_DEPS),
          ["looic", "looic_se", "looic_se_recomputed", "looic_uncorrected"])
def q_corrected_looic(spark, sf_dir):
    return corrected_by_model(spark, sf_dir).select(*RUN, "n_refit", F.col("looic_corrected").alias("looic"), "looic_se", "looic_se_recomputed",
                                                    F.col("looic").alias("looic_uncorrected"))


_INNER_LO, _INNER_HI = 3, 33
_ISL_INNER = _ISL.replace("from ll) x", f"""from ll where exists (select 1 from obs o where o.Country = ll.Country and o.i = ll.i
                                     and o.Age_i > {_INNER_LO} and o.Age_i < {_INNER_HI})) x""")


@register("is_loo_inner_ages", "J18 M2", _v(_ISL_INNER, ["ll", "obs"]), ["lpd", "elpd_is", "p_is"])
def q_is_loo_inner_ages(spark, sf_dir):
    obs = small_obs(spark, sf_dir).filter(
        (F.col("Age_i") > _INNER_LO) & (F.col("Age_i") < _INNER_HI)).select("Country", "i")
    return loo.is_loo(ll_variable(spark, sf_dir).join(obs, ["Country", "i"], "left_semi"))
