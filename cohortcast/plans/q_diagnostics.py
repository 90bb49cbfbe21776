"""Registered queries: convergence diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FIXTURE as C
from ..operators import diagnostics as dg
from ..operators import draws as dr
from ..operators.small import small_table
from ..sources import fixtures as fx
from .psis_sql import ess_views, psis_views
from .q_draws import DRAWS_LONG_SQL
from .registry import register
from .views_sql import with_views


def long_draws(spark, sf_dir):
    d = fx.draws(spark, sf_dir, C)
    return dr.draws_long(d, C)


def rhat_sql(subsets) -> dict[str, str]:
    n_iter = C.iters_per_chain
    rows = []
    for sid, chains, nc in subsets:
        for rank, ch in enumerate(chains, start=1):
            rows.append(f"('{sid}', {ch}, {rank}, {nc}, {len(chains)})")
    return {
        "subs": f"select * from (values {', '.join(rows)}) t(subset, Chain, rnk, nc, k)",
        "rx": f"""
select d.Country, d.param, s.subset, d.value, (s.rnk - 1)*{n_iter} + d.Iter as pos, s.k*{n_iter} as n, 2*s.nc as M
from dl d join subs s on d.Chain = s.Chain""",
        "rx2": """
select *, case when pos <= (n*((pos*M - 1)//n))//M + n//M then (pos*M - 1)//n + 1 else 0 end as blk from rx""",
        "seg": """
select Country, subset, param, blk, max(n) as n, max(M) as M, count(*) as cnt, sum(value) as sx, avg(value) as mx,
       coalesce(var_samp(value), 0.0)*(count(*) - 1) as ssd
from rx2 group by Country, subset, param, blk""",
        "seg2": """
select *, sum(sx) over (partition by Country, subset, param)/sum(cnt) over (partition by Country, subset, param) as grand
from seg""",
        "rh": """
select Country, subset, param,
       sqrt(((N - 1.0)/N*(sum_sm/M) + (sum_b*N/(M - 1.0))/N)/(sum_sm/M)) as rhat
from (select Country, subset, param, max(cast(M as double)) as M, max(cast(n as double)/cast(M as double)) as N,
             sum(ssd/(cast(n as double)/cast(M as double) - 1.0)) as sum_sm, sum((mx - grand)*(mx - grand)) as sum_b
      from seg2 where blk > 0 group by Country, subset, param) a""",
    }


_RH_DEPS = {"dl": ["draws"], "subs": [], "rx": ["dl", "subs"], "rx2": ["rx"], "seg": ["rx2"], "seg2": ["seg"],
            "rh": ["seg2"]}


def _rh(sql: str, subsets, views=("rh",), extra=None, extra_deps=None) -> str:
    ex = {"dl": DRAWS_LONG_SQL, **rhat_sql(subsets), **(extra or {})}
    deps = {**_RH_DEPS, **(extra_deps or {})}
    return with_views(sql, list(views), extra=ex, extra_deps=deps)


@register("split_rhat", "L1 E7", _rh("select Country, param, rhat from rh", dg.all_chains(C)), ["rhat"],
          overrides={"rhat": 9})
def q_split_rhat(spark, sf_dir):
    return dg.split_rhat(long_draws(spark, sf_dir), C).drop("subset")


_VERDICT = f"""
select Country, subset, max(rhat) as max_rhat, count(*) filter (where rhat > {C.rhat_threshold}) as n_large_rhat,
       count(*) filter (where rhat > {C.rhat_threshold}) = 0 as converged
from rh group by Country, subset"""


@register("rhat_drop_chain", "L4 L1 8.8", _rh(_VERDICT, dg.drop_one_chain(C)), ["max_rhat"], overrides={"max_rhat": 9})
def q_rhat_drop_chain(spark, sf_dir):
    return dg.rhat_verdicts(dg.split_rhat(long_draws(spark, sf_dir), C, dg.drop_one_chain(C)), C)


@register("rhat_chain_pairs", "L5 L1 8.8", _rh(_VERDICT, dg.chain_pairs(C)), ["max_rhat"], overrides={"max_rhat": 9})
def q_rhat_chain_pairs(spark, sf_dir):
    return dg.rhat_verdicts(dg.split_rhat(long_draws(spark, sf_dir), C, dg.chain_pairs(C)), C)


_PROBS = ", ".join(f"{p!r}e0" for p in dg.SUMMARY_PROBS)
_MOMENTS = "q[1] as q2_5, q[2] as q25, q[3] as q50, q[4] as q75, q[5] as q97_5"
_FAMILY = "regexp_replace(st.param, '\\[[0-9]{1,},*[0-9]*\\]', '') as Family"
_SUMMARY_SQL = f"""
, st AS (select Country, param, avg(value) as mean, stddev_samp(value) as sd, quantile_cont(value, [{_PROBS}]) as q
         from dl group by Country, param)
select st.Country, st.param, {_FAMILY}, mean, sd, {_MOMENTS}, rh.rhat, e.ess as n_eff, sd/sqrt(e.ess) as se_mean
from st join rh on st.Country = rh.Country and st.param = rh.param join pe_e e on e.Country = st.Country and e.param = st.param"""
_ESS, _ESS_DEPS = ess_views("pe", "Country, param", "dl", "value")
_SUMMARY_COLS = ["mean", "sd", "q2_5", "q25", "q50", "q75", "q97_5"]


@register("parameter_summary", "D15 D16 L1 L2", _rh("", dg.all_chains(C), views=("dl", "rh", "pe_e"), extra=_ESS, extra_deps=_ESS_DEPS) + _SUMMARY_SQL,
          [*_SUMMARY_COLS, "rhat", "n_eff", "se_mean"], overrides={**{k: 9 for k in [*_SUMMARY_COLS, "rhat", "se_mean"]}, "n_eff": 6})
def q_parameter_summary(spark, sf_dir):
    return dg.parameter_summary(long_draws(spark, sf_dir), C)


@register("parameter_summary_by_chain", "D15", with_views(f"""
select st.Country, st.Chain, st.param, {_FAMILY}, mean, sd, {_MOMENTS}
from (select Country, Chain, param, avg(value) as mean, stddev_samp(value) as sd, quantile_cont(value, [{_PROBS}]) as q
      from dl group by Country, Chain, param) st""", ["dl"], extra={"dl": DRAWS_LONG_SQL}, extra_deps={"dl": ["draws"]}),
          _SUMMARY_COLS, overrides={k: 9 for k in _SUMMARY_COLS})
def q_parameter_summary_by_chain(spark, sf_dir):
    return dg.parameter_summary_by_chain(long_draws(spark, sf_dir))


@register("divergent_chains", "L8 D17", with_views(f"""
select distinct Country, cast(floor((ind - 1)/{C.iters_per_chain}) as int) + 1 as Chain
from (select Country, (Chain - 1)*{C.iters_per_chain} + Iter as ind from sampler_params where divergent__ = 1) d""", ["sampler_params"]))
def q_divergent_chains(spark, sf_dir):
    """The chains that hold a run's divergent draws, from the draws' numbers."""
    at = (F.col("Chain") - 1) * F.lit(C.iters_per_chain) + F.col("Iter")
    inds = fx.sampler_params(spark, sf_dir, C).filter("divergent__ = 1").select("Country", at.alias("ind"))
    return dg.chains_from_inds(inds, C.n_draws, C.n_chains)


_FLAGS_SQL = f"""
, sp AS (select Country, cast(sum(divergent__) as bigint) as n_div,
                count(*) filter (where treedepth__ = {C.max_treedepth}) as n_max_treedepth
         from sampler_params group by Country)
, rv AS (select Country, max(rhat) as max_rhat, count(*) filter (where rhat > {C.rhat_threshold}) as n_large_rhat,
                count(*) as n_parameters from rh group by Country)
select sp.Country, n_parameters, n_div, n_max_treedepth, n_max_treedepth = 0 as treedepth_good, max_rhat, n_large_rhat,
       max_rhat < {C.rhat_threshold} as converged_rhat, max_rhat <= {C.rhat_threshold} and n_div = 0 as converged
from sp join rv on sp.Country = rv.Country"""


@register("sampler_flags", "D16 D17 D18 L3", _rh("", dg.all_chains(C), views=("sampler_params", "rh")) + _FLAGS_SQL,
          ["max_rhat"], overrides={"max_rhat": 9})
def q_sampler_flags(spark, sf_dir):
    rh = dg.split_rhat(long_draws(spark, sf_dir), C)
    return dg.sampler_flags(fx.sampler_params(spark, sf_dir, C), rh, C)


_ENERGY_SQL = """
, de AS (select Country, Chain, energy__, energy__ - lag(energy__) over (partition by Country, Chain order by Iter) as de
         from sampler_params)
, g AS (select Country, Chain, sum(de*de) as num, var_samp(energy__)*(count(*) - 1) as den from de group by Country, Chain)
select Country, Chain, num/den as ebfmi, num/den >= 0.2 as energy_good from g"""


@register("energy_flags", "L11", with_views("", ["sampler_params"]) + _ENERGY_SQL, ["ebfmi"])
def q_energy_flags(spark, sf_dir):
    return dg.energy_flags(fx.sampler_params(spark, sf_dir, C))


def _ess_sql() -> str:
    views, deps = ess_views("pe", "Country, param", "dl", "value")
    return with_views("select Country, param, s as n_draws, ess from pe_e", ["pe_e"], extra={"dl": DRAWS_LONG_SQL, **views},
                      extra_deps={"dl": ["draws"], **deps})


@register("ess", "L2", _ess_sql, ["ess"])
def q_ess(spark, sf_dir):
    return dg.effective_sample_size(long_draws(spark, sf_dir))


CHOICE_SUBSETS = dg.drop_one_chain(C) + dg.chain_pairs(C)


def has_chain_sql(bits: str, chain: str) -> str:
    return f"({bits} // (1 << ({chain} - 1)::int)) % 2 = 1"


def chains_text_sql(bits: str) -> str:
    return f"array_to_string(list_filter(range(1, {C.n_chains + 1}), lambda x: {has_chain_sql(bits, 'x')}), '_')"


def choice_views() -> tuple[dict[str, str], dict[str, list[str]]]:
    """cc: the chain decision by country (needs rh of the subsets, and ll), cct: the same with the chains as text."""
    n, every = C.n_chains, dg.chain_bits(C)
    js = range(2, n + 1)
    ok = lambda name: f"coalesce(bool_or(c) filter (where subset = '{name}'), false)"
    drop = " + ".join(f"(case when {ok(f'drop_{c}')} then {1 << (c - 1)} else 0 end)" for c in range(1, n + 1))
    union = lambda p: " | ".join(f"(case when {ok(f'{p}{j}')} then {1 | 1 << (j - 1)} else 0 end)" for j in js)
    first = "case " + " ".join(f"when {ok(f'without_1_{j}')} then {ok(f'pair_1_{j}')}" for j in js) + " else false end"
    found, deps = psis_views("cl", "Country, bits, i", "lls")
    views = {
        "v0": f"select Country, subset, count(*) filter (where rhat > {C.rhat_threshold}) = 0 as c from rh group by Country, subset",
        "v1": f"""
select Country, {drop} as dropped, {union('without_1_')} as rest_ok, {union('pair_1_')} as pair_ok, {first} as first_ok
from v0 group by Country""",
        "v2": f"""
select *, case when dropped > 0 then 'drop_one' when rest_ok = 0 and pair_ok = 0 then 'none'
               when rest_ok = 0 then 'keep_converged_pairs' when first_ok and rest_ok = {every} then 'none'
               when first_ok then 'compare_loo' else 'drop_pair' end as decision
from v1""",
        "lls": f"""
select l.Country, s.bits, l.i, l.Chain, l.Sim, l.ll
from ll l join (select Country, unnest([rest_ok, {every} - rest_ok]) as bits from v2 where decision = 'compare_loo') s
  on s.Country = l.Country and {has_chain_sql('s.bits', 'l.Chain')}""",
        **found,
        "le": "select Country, bits, sum(elpd_loo) as elpd from cl group by Country, bits",
        "cc": f"""
select v2.Country, decision,
       cast(case decision when 'drop_one' then dropped when 'keep_converged_pairs' then {every} - pair_ok
            when 'drop_pair' then rest_ok
            when 'compare_loo' then (case when a.elpd > b.elpd then {every} - rest_ok else rest_ok end) end as int) as discard
from v2 left join le a on a.Country = v2.Country and a.bits = rest_ok
        left join le b on b.Country = v2.Country and b.bits = {every} - rest_ok""",
        "cct": f"""
select Country, decision, discard, case when discard is null then null else coalesce({chains_text_sql('discard')}, '') end as discard_chains,
       case when discard is null then null else coalesce({chains_text_sql(f'({every} - discard)')}, '') end as keep_chains from cc""",
    }
    return views, {"v0": ["rh"], "v1": ["v0"], "v2": ["v1"], "lls": ["ll", "v2"], **deps, "le": ["cl"], "cc": ["v2", "le"], "cct": ["cc"]}


def choice_ctes() -> str:
    return "".join(f"\n, {k} AS ({v})" for k, v in choice_views()[0].items())


def _with_choice(sql: str, wanted: list[str], extra=None, extra_deps=None) -> str:
    from . import q_scoring as qs

    views, deps = choice_views()
    return _rh(sql, CHOICE_SUBSETS, views=wanted, extra={**qs._LL_VIEWS, "ll": qs._ll_select("variable"), **views, **(extra or {})},
               extra_deps={**qs._LL_DEPS, "ll": ["eb", "obs", "dispersion"], **deps, **(extra_deps or {})})


def verdicts_once(spark, sf_dir):
    """R-hat verdicts of all chains and of the subsets that the chain decision looks at, made once per session."""
    return small_table(spark, ("verdicts", sf_dir), lambda: dg.rhat_verdicts(
        dg.split_rhat(long_draws(spark, sf_dir), C, dg.all_chains(C) + CHOICE_SUBSETS), C), broadcast=False)


def choices(spark, sf_dir):
    """The chain decision, made once per session; only the sets that it has to compare get a LOO."""
    from .q_scoring import loglik_df

    def build():
        verdicts = verdicts_once(spark, sf_dir)
        pairs = dg.sets_to_compare(dg.chain_evidence(verdicts, C), C)
        return dg.chain_choice(verdicts, dg.set_elpds(dg.loo_of_sets(loglik_df(spark, sf_dir, "variable"), pairs)), C)

    return small_table(spark, ("choices", sf_dir), build, broadcast=False)


@register("chain_choice", "L6 L7 L8 L4 L5", lambda: _with_choice("select Country, decision, discard_chains, keep_chains from cct", ["cct"]))
def q_chain_choice(spark, sf_dir):
    return choices(spark, sf_dir).drop("discard")


def _compare_sql() -> str:
    found, deps = psis_views("pc", "Country, bits, i", "llp")
    pairs = ", ".join(f"({1 | 1 << (j - 1)}, {dg.chain_bits(C) - (1 | 1 << (j - 1))})" for j in range(2, C.n_chains + 1))
    views = {"pairs": f"select * from (values {pairs}) t(one, other)",
             "llp": f"""
select l.Country, s.bits, l.i, l.Chain, l.Sim, l.ll
from ll l join (select distinct unnest([one, other]) as bits from pairs) s on {has_chain_sql('s.bits', 'l.Chain')}""", **found}
    return _with_choice(f"""
select a.Country, {chains_text_sql('one')} as chains_one, {chains_text_sql('other')} as chains_other, count(*) as n_obs,
       sum(a.elpd_loo) as elpd_one, sum(b.elpd_loo) as elpd_other, sum(b.elpd_loo - a.elpd_loo) as elpd_diff,
       sqrt(count(*)*var_samp(b.elpd_loo - a.elpd_loo)) as se_diff
from pairs join pc a on a.bits = one join pc b on b.bits = other and b.Country = a.Country and b.i = a.i
group by a.Country, one, other""", ["pairs", "pc"], views, {"pairs": [], "llp": ["ll", "pairs"], **deps})


@register("loo_compare", "L7 L5 L8", _compare_sql, ["elpd_one", "elpd_other", "elpd_diff", "se_diff"])
def q_loo_compare(spark, sf_dir):
    """Every pair of chains {1, j} against the others, in every country."""
    from .q_scoring import loglik_df

    sides = F.explode(F.array(*[F.struct(F.lit(1 | 1 << (j - 1)).alias("one"), F.lit(dg.chain_bits(C) - (1 | 1 << (j - 1))).alias("other"))
                                for j in range(2, C.n_chains + 1)]))
    pairs = fx.countries(spark, sf_dir).select("Country", sides.alias("s")).select("Country", "s.one", "s.other")
    out = dg.loo_compare(dg.loo_of_sets(loglik_df(spark, sf_dir, "variable"), pairs), pairs)
    return out.select("Country", dg.bits_text(F.col("one"), C).alias("chains_one"), dg.bits_text(F.col("other"), C).alias("chains_other"),
                      "n_obs", "elpd_one", "elpd_other", "elpd_diff", "se_diff")
