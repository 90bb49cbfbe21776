"""Convergence diagnostics on stored draws.

Split R-hat is two levels of partial aggregation keyed by (run, subset, parameter,
segment).  Chain subsets (drop one chain, chain pairs and their complements) are
attached with an in-row ``explode`` of the subsets a row belongs to, so no cross
join and no per-subset loop on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CohortConfig
from . import psis
from .small import small_side

# a subset is (subset_id, sorted chains kept, n_chains argument passed to the R-hat)
Subset = tuple[str, tuple[int, ...], int]


def all_chains(cfg: CohortConfig) -> list[Subset]:
    return [("all", tuple(range(1, cfg.n_chains + 1)), cfg.n_chains)]


def drop_one_chain(cfg: CohortConfig) -> list[Subset]:
    """L4: every chain left out in turn; the reference passes n_chains = (chains - 1) * 2."""
    chains = range(1, cfg.n_chains + 1)
    return [(f"drop_{c}", tuple(x for x in chains if x != c), (cfg.n_chains - 1) * 2) for c in chains]


def chain_pairs(cfg: CohortConfig) -> list[Subset]:
    """Pairs {1, j} and their complements, with the same n_chains argument."""
    chains = tuple(range(1, cfg.n_chains + 1))
    out: list[Subset] = []
    for j in chains[1:]:
        pair = (1, j)
        comp = tuple(c for c in chains if c not in pair)
        out.append((f"pair_1_{j}", pair, (cfg.n_chains - 1) * 2))
        out.append((f"without_1_{j}", comp, (cfg.n_chains - 1) * 2))
    return out


def _subset_array(subsets: list[Subset]):
    return F.array(*[
        F.struct(F.lit(sid).alias("sid"), F.array(*[F.lit(c) for c in chains]).alias("chains"),
                 F.lit(nc).alias("nc"))
        for sid, chains, nc in subsets
    ])


def split_rhat(long: DataFrame, cfg: CohortConfig, subsets: list[Subset] | None = None,
               keys: tuple[str, ...] = ("Country",)) -> DataFrame:
    """L1 with the segment rule of 8.8: rows of a subset ordered by (chain position, Iter),
    M = 2 * n_chains argument, N = n / M (may be fractional); segment i takes rows
    floor(N (i-1)) + 1 .. floor(N (i-1)) + floor(N); the grand mean uses all rows."""
    subsets = subsets or all_chains(cfg)
    n_iter = cfg.iters_per_chain
    k = list(keys)
    s = F.explode(F.filter(_subset_array(subsets), lambda x: F.array_contains(x["chains"], F.col("Chain"))))
    x = long.select(*k, "param", "Chain", "Iter", "value", s.alias("s"))
    pos = (F.array_position(F.col("s.chains"), F.col("Chain")) - F.lit(1)) * F.lit(n_iter) + F.col("Iter")
    n = F.size(F.col("s.chains")) * F.lit(n_iter)
    m = F.lit(2) * F.col("s.nc")
    blk0 = F.floor((pos * m - F.lit(1)) / n)                      # i - 1
    start = F.floor(n * blk0 / m)                                 # floor(N (i-1))
    in_blk = pos <= start + F.floor(n / m)
    x = x.select(*k, "param", F.col("s.sid").alias("subset"), F.col("s.nc").alias("nc"), n.alias("n"), "value",
                 F.when(in_blk, blk0 + F.lit(1)).otherwise(F.lit(0)).cast("int").alias("blk"))
    seg = x.groupBy(*k, "subset", "param", "blk").agg(
        F.first("nc").alias("nc"), F.first("n").alias("n"),
        F.count(F.lit(1)).alias("cnt"), F.sum("value").alias("sx"), F.avg("value").alias("mx"),
        (F.coalesce(F.var_samp("value"), F.lit(0.0)) * (F.count(F.lit(1)) - F.lit(1))).alias("ssd"),
    )
    w = Window.partitionBy(*k, "subset", "param")
    seg = seg.withColumn("grand", F.sum("sx").over(w) / F.sum("cnt").over(w))
    seg = seg.filter(F.col("blk") > 0)
    mm = (F.lit(2) * F.col("nc")).cast("double")
    nn = F.col("n").cast("double") / mm
    agg = seg.groupBy(*k, "subset", "param").agg(
        F.first(mm).alias("M"), F.first(nn).alias("N"),
        F.sum(F.col("ssd") / (nn - F.lit(1.0))).alias("sum_sm"),
        F.sum((F.col("mx") - F.col("grand")) * (F.col("mx") - F.col("grand"))).alias("sum_b"),
    )
    W = F.col("sum_sm") / F.col("M")
    B = F.col("sum_b") * F.col("N") / (F.col("M") - F.lit(1.0))
    rhat = F.sqrt(((F.col("N") - F.lit(1.0)) / F.col("N") * W + B / F.col("N")) / W)
    return agg.select(*k, "subset", "param", rhat.alias("rhat"))


def rhat_verdicts(rhat: DataFrame, cfg: CohortConfig, keys: tuple[str, ...] = ("Country",)) -> DataFrame:
    """L3 R-hat part / L4-L5: per subset, max R-hat, count above the threshold, converged flag."""
    th = cfg.rhat_threshold
    return rhat.groupBy(*keys, "subset").agg(
        F.max("rhat").alias("max_rhat"),
        F.count(F.when(F.col("rhat") > th, 1)).alias("n_large_rhat"),
        (F.count(F.when(F.col("rhat") > th, 1)) == 0).alias("converged"),
    )


def family(param):
    """``Family`` = parameter name without its index."""
    return F.regexp_replace(param, r"\[[0-9]{1,},*[0-9]*\]", "")


SUMMARY_PROBS = (0.025, 0.25, 0.5, 0.75, 0.975)


_SUMMARY_NAMES = ["q2_5", "q25", "q50", "q75", "q97_5"]


def _moments(long: DataFrame, keys: list[str]) -> DataFrame:
    s = long.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.percentile(F.col("value"), F.array(*[F.lit(p) for p in SUMMARY_PROBS])).alias("q"),
    )
    return s.select(*keys, family(F.col("param")).alias("Family"), "mean", "sd", *[F.col("q")[i].alias(n) for i, n in enumerate(_SUMMARY_NAMES)])


def parameter_summary(long: DataFrame, cfg: CohortConfig, keys: tuple[str, ...] = ("Country",)) -> DataFrame:
    """Posterior summary per parameter over all chains: mean, its standard error sd / sqrt(n_eff), sd, type-7 quantiles,
    effective sample size and split R-hat."""
    k = [*keys, "param"]
    s = _moments(long, k).join(split_rhat(long, cfg, keys=keys).drop("subset"), k)
    ess = psis.over_draws(long, k, "value", ["n_eff"], lambda x, chains: [psis.ess_rows(psis.chain_cube(x, chains))])
    return s.join(ess, k).withColumn("se_mean", F.col("sd") / F.sqrt("n_eff"))


def parameter_summary_by_chain(long: DataFrame, keys: tuple[str, ...] = ("Country",)) -> DataFrame:
    """D15 of each chain: moments and quantiles of its draws."""
    return _moments(long, [*keys, "Chain", "param"])


def run_time(elapsed: DataFrame, keys: tuple[str, ...] = ("Country",)) -> DataFrame:
    """Minutes of a run, those of its slowest chain (warm-up and sampling)."""
    return elapsed.groupBy(*keys).agg((F.max(F.col("warmup") + F.col("sampling")) / F.lit(60.0)).alias("runtime_min"))


def sampler_flags(sampler: DataFrame, rhat: DataFrame, cfg: CohortConfig, keys: tuple[str, ...] = ("Country",)) -> DataFrame:
    """D16-D18 + L3: divergences, max-treedepth hits, R-hat verdict and overall convergence."""
    k = list(keys)
    sp = sampler.groupBy(*k).agg(
        F.sum("divergent__").cast("long").alias("n_div"),
        F.count(F.when(F.col("treedepth__") == cfg.max_treedepth, 1)).alias("n_max_treedepth"),
    )
    rv = rhat.groupBy(*k).agg(
        F.max("rhat").alias("max_rhat"),
        F.count(F.when(F.col("rhat") > cfg.rhat_threshold, 1)).alias("n_large_rhat"),
        F.count(F.lit(1)).alias("n_parameters"),  # L10: sampled parameters (one R-hat each)
    )
    j = sp.join(rv, k)
    return j.select(
        *k, "n_parameters", "n_div", "n_max_treedepth", (F.col("n_max_treedepth") == 0).alias("treedepth_good"),
        "max_rhat", "n_large_rhat", (F.col("max_rhat") < cfg.rhat_threshold).alias("converged_rhat"),
        ((F.col("max_rhat") <= cfg.rhat_threshold) & (F.col("n_div") == 0)).alias("converged"),
    )


def energy_flags(sampler: DataFrame, keys: tuple[str, ...] = ("Country",), threshold: float = 0.2) -> DataFrame:
    """E-BFMI per chain, sum(diff(E)^2) / sum((E - mean E)^2), flagged below 0.2."""
    k = list(keys)
    w = Window.partitionBy(*k, "Chain").orderBy("Iter")
    d = sampler.select(*k, "Chain", "energy__", (F.col("energy__") - F.lag("energy__").over(w)).alias("de"))
    g = d.groupBy(*k, "Chain").agg(
        F.sum(F.col("de") * F.col("de")).alias("num"),
        (F.var_samp("energy__") * (F.count(F.lit(1)) - F.lit(1))).alias("den"),
    )
    e = (F.col("num") / F.col("den"))
    return g.select(*k, "Chain", e.alias("ebfmi"), (e >= threshold).alias("energy_good"))


def chains_from_inds(inds: DataFrame, n_iter_total: int, n_chains: int) -> DataFrame:
    """Draw indices -> distinct chain numbers, floor((i - 1) / iters_per_chain) + 1."""
    per = n_iter_total // n_chains
    return inds.select(*[c for c in inds.columns if c != "ind"],
                       (F.floor((F.col("ind") - F.lit(1)) / F.lit(per)) + F.lit(1)).cast("int").alias("Chain")).distinct()


# --- L2 effective sample size ----------------------------------------------------
def effective_sample_size(long: DataFrame) -> DataFrame:
    """L2: number of draws and effective sample size of every (Country, parameter)."""
    def rows(x: np.ndarray, chains: np.ndarray) -> list[np.ndarray]:
        return [np.full(len(x), float(x.shape[1])), psis.ess_rows(psis.chain_cube(x, chains))]

    found = psis.over_draws(long, ["Country", "param"], "value", ["n_draws", "ess"], rows)
    return found.withColumn("n_draws", F.col("n_draws").cast("long"))


# --- L6-L8: which chains to discard for a multimodal run ---------------------------
def chain_bits(cfg: CohortConfig) -> int:
    """All chains as a bit set: chain c is bit c - 1."""
    return (1 << cfg.n_chains) - 1


def bits_text(bits, cfg: CohortConfig):
    """'1_3' for the chains of a bit set."""
    chains = F.array(*[F.lit(c) for c in range(1, cfg.n_chains + 1)])
    held = F.filter(chains, lambda c: has_chain(bits, c))
    return F.when(bits.isNotNull(), F.array_join(F.transform(held, lambda c: c.cast("string")), "_"))


def has_chain(bits, chain):
    return F.floor(bits / F.pow(F.lit(2), chain - 1)) % 2 == 1


def chain_evidence(verdicts: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Per run, from the R-hat verdicts of the subsets, bit sets of the chains whose removal alone converges
    (``drop``), of the pairs {1, j} whose removal converges (``rest_ok``) and of those that converge (``pair_ok``), and the
    ``decision`` that they lead to."""
    every, chains = chain_bits(cfg), range(1, cfg.n_chains + 1)

    def bits_where(prefix: str, members) -> list:
        return [F.max(F.when((F.col("subset") == f"{prefix}{c}") & F.col("converged"), F.lit(members(c))).otherwise(0)) for c in chains]

    def union(cols):
        out = cols[0]
        for c in cols[1:]:
            out = out.bitwiseOR(c)
        return out

    def number_of(prefix):
        return F.when(F.col("subset").startswith(prefix) & F.col("converged"), F.regexp_extract("subset", "([0-9]+)$", 1).cast("int"))

    pair = lambda j: 1 | 1 << (j - 1)
    v = verdicts.groupBy("Country").agg(
        union(bits_where("drop_", lambda c: 1 << (c - 1))).alias("drop"),
        union(bits_where("without_1_", pair)).alias("rest_ok"),
        union(bits_where("pair_1_", pair)).alias("pair_ok"),
        F.min(number_of("without_1_")).alias("first"), F.collect_set(number_of("pair_1_")).alias("pairs"),
    )
    rest = F.col("rest_ok")
    both = F.array_contains("pairs", F.col("first"))
    decision = (F.when(F.col("drop") > 0, "drop_one").when((rest == 0) & (F.col("pair_ok") == 0), "none")
                .when(rest == 0, "keep_converged_pairs").when(both & (rest == every), "none")
                .when(both, "compare_loo").otherwise("drop_pair"))
    return v.select("Country", "drop", "rest_ok", "pair_ok", decision.alias("decision"))


def sets_to_compare(evidence: DataFrame, cfg: CohortConfig) -> DataFrame:
    """(Country, one, other): the chain sets between which the LOO of a run decides."""
    return evidence.filter(F.col("decision") == "compare_loo").select(
        "Country", F.col("rest_ok").alias("one"), (F.lit(chain_bits(cfg)) - F.col("rest_ok")).alias("other"))


def chain_choice(verdicts: DataFrame, subset_elpd: DataFrame, cfg: CohortConfig) -> DataFrame:
    """L6 (L4, L5, L7): per run the chains to discard, from the R-hat verdicts of the subsets; ``subset_elpd`` has elpd by
    (Country, bits).

    Every chain whose removal alone converges goes (quirk X18).  Else the pairs {1, j} decide: all pairs whose removal
    converges go, unless the first of these pairs converges itself, when the side with the better elpd stays (none can be
    told where the pairs hold every chain); if only pairs converge but no remainder does, all chains outside of these
    pairs go."""
    every = chain_bits(cfg)
    v, rest = chain_evidence(verdicts, cfg), F.col("rest_ok")
    v = v.join(subset_elpd.select("Country", F.col("bits").alias("rest_ok"), F.col("elpd").alias("in_elpd")), ["Country", "rest_ok"], "left")
    v = v.withColumn("other", F.lit(every) - rest).join(
        subset_elpd.select("Country", F.col("bits").alias("other"), F.col("elpd").alias("out_elpd")), ["Country", "other"], "left")
    discard = (F.when(F.col("decision") == "drop_one", F.col("drop"))
               .when(F.col("decision") == "keep_converged_pairs", F.lit(every) - F.col("pair_ok"))
               .when(F.col("decision") == "drop_pair", rest)
               .when(F.col("decision") == "compare_loo", F.when(F.col("in_elpd") > F.col("out_elpd"), F.lit(every) - rest).otherwise(rest)))
    v = v.withColumn("discard", discard)
    return v.select("Country", "decision", F.col("discard").cast("int").alias("discard"),
                    bits_text(F.col("discard"), cfg).alias("discard_chains"),
                    bits_text(F.lit(every) - F.col("discard"), cfg).alias("keep_chains"))


def loo_of_sets(ll: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pointwise PSIS by (Country, bits, i) of the chain sets in ``pairs`` (Country, one, other), from their own draws."""
    sets = pairs.select("Country", F.explode(F.array("one", "other")).alias("bits")).distinct()
    rows = ll.join(small_side(sets), "Country").filter(has_chain(F.col("bits"), F.col("Chain")))
    return psis.over_draws(rows, ["Country", "bits", "i"], "ll", ["elpd_loo", "p_loo", "looic", "pareto_k", "r_eff"], psis.loo_rows)


def set_elpds(pointwise: DataFrame) -> DataFrame:
    return pointwise.groupBy("Country", "bits").agg(F.sum("elpd_loo").alias("elpd"))


def loo_compare(pointwise: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both sets' elpd, the other's gain over the one, and its standard error from the paired pointwise differences."""
    side = lambda c: pairs.join(pointwise.select("Country", F.col("bits").alias(c), "i", F.col("elpd_loo").alias(f"elpd_{c}")), ["Country", c])
    j = side("one").join(side("other"), ["Country", "one", "other", "i"])
    gain = F.col("elpd_other") - F.col("elpd_one")
    return j.groupBy("Country", "one", "other").agg(
        F.count(F.lit(1)).alias("n_obs"), F.sum("elpd_one").alias("elpd_one"), F.sum("elpd_other").alias("elpd_other"),
        F.sum(gain).alias("elpd_diff"), F.sqrt(F.count(gain) * F.var_samp(gain)).alias("se_diff"))


def chains_in_use(verdicts: DataFrame, flags: DataFrame, choice: DataFrame, cfg: CohortConfig) -> DataFrame:
    """M3: (Country, loo_eligible, discard).  A run with divergences has no LOO.  One whose R-hat fails gives up the chains
    that the chain decision names, and has no LOO where it names none or all; any other keeps all chains."""
    all_ok = verdicts.filter(F.col("subset") == "all").select("Country", F.col("converged").alias("ok"))
    j = all_ok.join(flags.select("Country", "n_div"), "Country").join(choice.select("Country", "discard"), "Country", "left")
    told = F.col("discard").isNotNull() & (F.col("discard") != chain_bits(cfg))
    return j.select("Country", ((F.col("n_div") == 0) & (F.col("ok") | told)).alias("loo_eligible"),
                    F.when(~F.col("ok") & told, F.col("discard")).otherwise(0).cast("int").alias("discard"))


def without_discarded(ll: DataFrame, use: DataFrame) -> DataFrame:
    """Draws of the chains that a run keeps (``use`` has a row per run: broadcast behind its size check)."""
    return ll.join(small_side(use.select("Country", "discard")), "Country").filter(~has_chain(F.col("discard"), F.col("Chain"))).drop("discard")
