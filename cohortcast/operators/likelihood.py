"""Likelihood and prior on stored draws.

Physical plan (per model run, all countries at once):

    draws (hash-partitioned by Country, Sim)
      -> cells with their exposure       broadcast join, exposure grid is size-checked
      -> rate at these cells (projection), E = 1e-6 + rate * exposure
      -> tail bins: groupBy(Country, Sim, Cohort, clamped Age)   <- reuses (Country, Sim)
      -> observations                    broadcast join, size-checked
      -> dispersion per draw             join on (Country, Sim): co-partitioned
      -> NB / Poisson log pmf

so the only exchange over draw-level rows is the (cheap, draw-level) partitioning
of the draws themselves.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CohortConfig
from ..functions.numeric import hash_normal, lgamma, nb_lpmf, normal_lpdf, poisson_lpmf, with_lgamma
from .draws import rate_draws
from .rates import clamp_age
from .small import small_side


def dispersion_maps(dispersion: DataFrame) -> DataFrame:
    """(Country, Sim, dmap, disp_const): of each draw, the dispersion by age (n_ages_obs entries) and, of the constant
    variant, the one that has no age; what a variant lacks is empty or null."""
    by_age = F.collect_list(F.when(F.col("Age").isNotNull(), F.struct(F.col("Age").cast("int"), F.col("Dispersion"))))
    const = F.max(F.when(F.col("Age").isNull(), F.col("Dispersion")))
    return dispersion.groupBy("Country", "Sim").agg(F.map_from_entries(by_age).alias("dmap"), const.alias("disp_const"))


def dispersion_at(age: Column) -> Column:
    """Of the columns of ``dispersion_maps``: the draw's dispersion at an age."""
    return F.coalesce(F.element_at("dmap", age.cast("int")), F.col("disp_const"))


def observed_grid(expos_grid: DataFrame, obs: DataFrame, cfg: CohortConfig) -> DataFrame:
    """The cells of the exposure grid that an observation takes up, edge bins with all the ages folded into them: the likelihood
    needs no draw's rate elsewhere."""
    bins = obs.select("Country", "Cohort", F.col("Age").alias("_bin")).distinct()
    cells = expos_grid.withColumn("_bin", clamp_age(F.col("Age"), cfg.first_data_age, cfg.last_data_age))
    return cells.join(bins, ["Country", "Cohort", "_bin"], "left_semi").drop("_bin")


def expected_births(draws: DataFrame, expos_grid: DataFrame, cfg: CohortConfig, param_func: tuple[str, str] | None = None,
                    model_keys: tuple[str, ...] = (), pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """J14 first half + D23/D24: expected births per (draw, cohort, observed age) with the
    ages outside the observed range folded into the edge bins; also sum(E^2) for the
    effective dispersion of the folded bins."""
    jo = cfg.jump_off
    fda, lda = cfg.first_data_age, cfg.last_data_age
    d = draws.filter(F.col("Cohort") <= cfg.last_insample_cohort)  # only in-sample cohorts have exposure
    # derived filter before the densities: keep cells that can be observed (Year <= jump-off)
    keep = ["Chain", "Iter", *(model_keys if pairs is None else ())]
    j = rate_draws(d, cfg, param_func, keep=keep, cells=expos_grid.select("Country", "Cohort", "Age", "Exposure"), pairs=pairs,
                   age_filter=lambda age: F.col("Cohort") + clamp_age(age, fda, lda) <= F.lit(jo))
    e = F.lit(1e-06) + F.col("Rate") * F.col("Exposure")
    return j.groupBy("Country", *model_keys, "Sim", "Chain", "Iter", "Cohort",
                     clamp_age(F.col("Age"), fda, lda).alias("Age")).agg(
        F.sum(e).alias("E"), F.sum(e * e).alias("E2")
    )


def pointwise_loglik(eb: DataFrame, obs: DataFrame, disp_maps: DataFrame | None, dispersion: str,
                     cfg: CohortConfig, model_keys: tuple[str, ...] = ()) -> DataFrame:
    """J14 second half (I6, I7, I14): log likelihood of every observation under every draw.

    dispersion: ``variable`` / ``var_unsmooth`` (per-age dispersion, folded bins use
    disp * (sum E)^2 / sum(E^2)), ``constant`` (one value per draw; in the fixture the
    draw's unindexed dispersion, or that at the first observed age where it has none), ``poisson`` (no dispersion)."""
    of_count = lgamma(F.col("births") + F.lit(1.0)).alias("lg_count")  # once per observation, not per draw
    o = eb.join(obs.select("Country", "Cohort", "Age", "i", "Age_i", "births", "n_ages_obs", of_count), ["Country", "Cohort", "Age"])
    y, mu = F.col("births"), F.col("E")
    if dispersion == "poisson":
        ll = poisson_lpmf(y, mu)
    else:
        # co-partitioned on (Country, Sim); the hint keeps the per-draw maps as the build
        # side (size estimates of exploded inputs are too low to pick a side by stats)
        o = o.join(disp_maps.hint("shuffle_hash"), ["Country", "Sim"])
        if dispersion == "constant":
            disp = F.coalesce("disp_const", F.element_at("dmap", F.lit(cfg.first_data_age)))
        elif dispersion in ("variable", "var_unsmooth"):
            base = dispersion_at(F.col("Age"))
            folded = (F.col("Age_i") == 1) | (F.col("Age_i") == F.col("n_ages_obs"))
            disp = F.when(folded, base * F.col("E") * F.col("E") / F.col("E2")).otherwise(base)
        else:
            raise ValueError(f"unknown dispersion variant {dispersion!r}")
        o = o.select("Country", *model_keys, "Sim", "Chain", "Iter", "i", "births", "E", "lg_count", disp.alias("disp"))
        o = with_lgamma(o, {"lg_sum": y.cast("double") + F.col("disp"), "lg_size": F.col("disp")})
        ll = nb_lpmf(y, mu, F.col("disp"), (F.col("lg_sum"), F.col("lg_size"), F.col("lg_count")))
    return o.select("Country", *model_keys, "Sim", "Chain", "Iter", "i", ll.alias("ll"))


def loglik(draws: DataFrame, expos_grid: DataFrame, obs: DataFrame, dispersion_draws: DataFrame | None,
           cfg: CohortConfig, dispersion: str = "variable", param_func: tuple[str, str] | None = None,
           model_keys: tuple[str, ...] = (), pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Pointwise log likelihood.  With ``model_keys`` (e.g. ("p1", "p2")) the draws carry
    the model's density names as columns and all models are evaluated in one job; with
    ``pairs`` of density names, the same draws are taken under each of them (columns p1, p2).

    ``expos_grid`` (whole, or its ``observed_grid``) and ``obs`` are the small sides: pass
    them through ``operators.small.small_side`` (size-checked broadcast); the exploded draw
    side must never be chosen as a build side on (under-estimated) statistics."""
    model_keys = model_keys if pairs is None else ("p1", "p2")
    eb = expected_births(draws, expos_grid, cfg, param_func, model_keys, pairs)
    maps = None if dispersion == "poisson" else dispersion_maps(dispersion_draws)
    return pointwise_loglik(eb, obs, maps, dispersion, cfg, model_keys)


def drop_sets(lko_runs: DataFrame, keys: tuple[str, ...] = ("Country",)) -> DataFrame:
    """(keys, i) of every left-out observation from ``inds`` strings like '3_17_20'."""
    return lko_runs.filter(F.col("inds").isNotNull() & (F.col("inds") != "")).select(
        *keys, F.explode(F.split("inds", "_")).alias("i")
    ).select(*keys, F.col("i").cast("int").alias("i"))


def fold_bits(folds: DataFrame, keys: tuple[str, ...] = ("Country",)) -> DataFrame:
    """(keys, i, out): the folds that leave out an observation, as a bit set (fold f is bit f - 1)."""
    return folds.groupBy(*keys, "i").agg(F.bit_or(F.expr("shiftleft(1L, fold - 1)")).alias("out"))


def loglik_keep(ll: DataFrame, folds: DataFrame, keys: tuple[str, ...] = ("Country",), n_folds: int = 3) -> DataFrame:
    """J15 + C12 + M9: per-draw log likelihood total over the observations that a refit keeps, for every run of ``folds``
    (keys, i, fold), from one scan of ``ll``: each row is added to all folds whose bit it hasn't."""
    k = list(keys)
    j = ll.join(small_side(fold_bits(folds, keys)), [*k, "i"], "left")
    kept = [(F.coalesce(F.col("out"), F.lit(0)).bitwiseAND(F.lit(1 << f)) == 0, f) for f in range(n_folds)]
    sums = j.groupBy(*k, "Sim").agg(*[c for has, f in kept for c in (
        F.sum(F.when(has, F.col("ll"))).alias(f"ll_{f}"), F.count(F.when(has, F.lit(1))).alias(f"n_{f}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(f + 1).alias("fold"), F.col(f"ll_{f}").alias("ll_keep"), F.col(f"n_{f}").alias("n_keep")) for f in range(n_folds)]))
    long = sums.select(*k, "Sim", rows.alias("r")).select(*k, F.col("r.fold").alias("fold"), "Sim", "r.ll_keep", "r.n_keep")
    return long.join(small_side(folds.select(*k, "fold").distinct()), [*k, "fold"])


# --- prior (J16) -------------------------------------------------------------
# Prior of the first time point of every random walk, (mean, sd, lower bound).
INITIAL_PRIORS = {
    "CEB": (2.1, 0.3, 0.0),
    "mode_age_sum": (58.0, 2.5, None),
    "mode_age_gap": (8.0, 2.0, None),
    "sd_1": (5.0, 2.0, 1.0),
    "sd_2": (5.0, 2.0, 1.0),
    "logit_mixture": (0.0, 5.0, None),
}
SIGMA_PRIOR_SD = 4.0
RW_SCALE = 0.1


#: Standard deviations of the dispersion priors by variant: first coefficient, step in units of sigma, sigma.
DISPERSION_PRIORS = {"variable": (5.0, 0.1, 5.0), "var_unsmooth": (4.0, 1.0, 1.0)}


def log_prior_given_sigmas(draws: DataFrame, sigmas: DataFrame, axis: str = "Cohort", initial: dict | None = None) -> DataFrame:
    """J16 with the sigmas of each draw (Country, Sim, sigma_<parameter>): the random walks' increments scale with them, and
    each has its half-normal prior.  ``initial`` replaces priors of the first time point (parameter: mean, sd, lower bound)."""
    w = Window.partitionBy("Country", "Sim").orderBy(axis)
    first = F.row_number().over(w) == 1
    priors = {**INITIAL_PRIORS, **(initial or {})}
    names = [f"sigma_{p}" for p in priors]
    lp, own = F.lit(0.0), F.lit(0.0)
    for p, (mu0, sd0, lower) in priors.items():
        start = normal_lpdf(F.col(p), F.lit(mu0), F.lit(sd0))
        if lower is not None:
            start = start - F.lit(math.log(1.0 - NormalDist(mu0, sd0).cdf(lower)))
        step = normal_lpdf(F.col(p) - F.lag(p).over(w), F.lit(0.0), F.lit(RW_SCALE) * F.col(f"sigma_{p}"))
        lp = lp + F.when(first, start).otherwise(step)
        own = own + normal_lpdf(F.col(f"sigma_{p}"), F.lit(0.0), F.lit(SIGMA_PRIOR_SD))
    # both sides are partitioned by draw; the sigmas are the smaller one
    j = draws.join(sigmas.select("Country", "Sim", *names).hint("shuffle_hash"), ["Country", "Sim"])
    per_t = j.select("Country", "Sim", lp.alias("lp"), F.when(first, own).otherwise(0.0).alias("own"))
    return per_t.groupBy("Country", "Sim").agg((F.sum("lp") + F.sum("own")).alias("log_prior"))


def log_prior_dispersion(coefs: DataFrame, sigma: DataFrame, variant: str) -> DataFrame:
    """J16 of the dispersion: a random walk over the coefficients ``k`` and the prior of its sigma, by draw."""
    start_sd, scale, sigma_sd = DISPERSION_PRIORS[variant]
    w = Window.partitionBy("Country", "Sim").orderBy("k")
    j = coefs.join(sigma.select("Country", "Sim", "sigma_disp").hint("shuffle_hash"), ["Country", "Sim"])
    first = F.row_number().over(w) == 1
    start = normal_lpdf(F.col("beta"), F.lit(0.0), F.lit(start_sd)) + normal_lpdf(F.col("sigma_disp"), F.lit(0.0), F.lit(sigma_sd))
    step = normal_lpdf(F.col("beta") - F.lag("beta").over(w), F.lit(0.0), F.lit(scale) * F.col("sigma_disp"))
    return j.select("Country", "Sim", F.when(first, start).otherwise(step).alias("lp")).groupBy("Country", "Sim").agg(
        F.sum("lp").alias("log_prior"))


def reweighting(old: DataFrame, new: DataFrame) -> DataFrame:
    """Normalised importance weights of a run's draws under another prior: (Country, Sim, weight) from both log priors.  The
    window holds the draws of one run."""
    run = Window.partitionBy("Country")
    j = old.join(new.withColumnRenamed("log_prior", "log_new"), ["Country", "Sim"])
    j = j.select("Country", "Sim", (F.col("log_new") - F.col("log_prior")).alias("lw"))
    j = j.select("Country", "Sim", F.exp(F.col("lw") - F.max("lw").over(run)).alias("w"))
    return j.select("Country", "Sim", (F.col("w") / F.sum("w").over(run)).alias("weight"))


def reweighted_summary(long: DataFrame, weights: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Weighted mean, sd and quantiles (the least value whose cumulated weight reaches p) of every parameter, and the effective
    number of draws 1 / sum(weight^2).  A window holds the draws of one parameter of a run."""
    j = long.select("Country", "Sim", "param", "value").join(weights.hint("shuffle_hash"), ["Country", "Sim"])
    up = Window.partitionBy("Country", "param").orderBy("value", "Sim").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("Country", "param")
    j = j.select("*", (F.sum("weight").over(up) / F.sum("weight").over(every)).alias("reached"),
                 F.sum(F.col("weight") * F.col("value")).over(every).alias("m"))
    d = F.col("value") - F.col("m")
    return j.groupBy("Country", "param").agg(
        F.max("m").alias("mean"), F.sqrt(F.sum(F.col("weight") * d * d)).alias("sd"),
        *[F.min(F.when(F.col("reached") >= p, F.col("value"))).alias(n) for n, p in probs.items()],
        (F.lit(1.0) / F.sum(F.col("weight") * F.col("weight"))).alias("n_eff_weights"))


def log_prior(draws: DataFrame, sigmas: dict[str, float] | None = None, axis: str = "Cohort") -> DataFrame:
    """J16 (E5, I11): log prior density of each stored draw: random-walk increments
    N(0, 0.1 sigma), initial-value priors (truncated where the parameter is bounded)
    and the half-normal(0, 4) priors of the six sigmas (held at ``sigmas``)."""
    sigmas = sigmas or {p: 1.0 for p in INITIAL_PRIORS}
    w = Window.partitionBy("Country", "Sim").orderBy(axis)
    first = F.row_number().over(w) == 1
    terms = []
    for p, (mu0, sd0, lower) in INITIAL_PRIORS.items():
        init = normal_lpdf(F.col(p), F.lit(mu0), F.lit(sd0))
        if lower is not None:  # truncation T[lower,]: divide by P(X > lower)
            init = init - F.lit(math.log(1.0 - NormalDist(mu0, sd0).cdf(lower)))
        step = normal_lpdf(F.col(p) - F.lag(p).over(w), F.lit(0.0), F.lit(RW_SCALE * sigmas[p]))
        terms.append(F.when(first, init).otherwise(step))
    const = sum(
        -0.5 * (s / SIGMA_PRIOR_SD) ** 2 - math.log(SIGMA_PRIOR_SD) - 0.5 * math.log(2 * math.pi)
        for s in sigmas.values()
    )
    lp = terms[0]
    for t in terms[1:]:
        lp = lp + t
    per_t = draws.select("Country", "Sim", lp.alias("lp"))
    return per_t.groupBy("Country", "Sim").agg((F.sum("lp") + F.lit(const)).alias("log_prior"))


# --- J17: random-walk extension of stored draws ------------------------------------
# Lower bounds of the bounded random walks (model parameter constraints).
RW_LOWER = {"CEB": 0.0, "sd_1": 1.0, "sd_2": 1.0, "mode_age_gap": 2.0, "mode_age_sum": 36.0}


def rw_extension(draws: DataFrame, cfg: CohortConfig, steps: int | None = None,
                 sigmas: dict[str, float] | None = None, axis: str = "Cohort") -> DataFrame:
    """Extend every stored draw ``steps`` time points past its last one with the
    model's random walks, eta[t] = eta[t-1] + N(0, (0.1 sigma)^2); a draw whose path
    leaves a parameter's support anywhere is rejected (all its rows dropped)."""
    steps = steps or cfg.T_forecast
    sigmas = sigmas or {p: 1.0 for p in INITIAL_PRIORS}
    last_t = cfg.start_time + cfg.T_total - 1
    last = draws.filter(F.col(axis) == last_t)
    ext = last.select("Country", "Sim", *INITIAL_PRIORS, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("h"))
    cols = []
    def step(pid):
        return lambda acc, j: acc + hash_normal(cfg.seed, F.col("Country"), F.col("Sim"), F.lit(pid), j)

    for pid, p in enumerate(INITIAL_PRIORS):
        inc = F.aggregate(F.sequence(F.lit(1), F.col("h")), F.lit(0.0), step(pid))
        cols.append((F.col(p) + F.lit(RW_SCALE * sigmas[p]) * inc).alias(p))
    out = ext.select("Country", "Sim", (F.lit(last_t) + F.col("h")).cast("long").alias(axis), *cols)
    ok = None
    for p, lo in RW_LOWER.items():
        c = F.col(p) > F.lit(lo)
        ok = c if ok is None else ok & c
    w = Window.partitionBy("Country", "Sim")
    out = out.withColumn("_ok", F.min(ok.cast("int")).over(w))
    return out.filter(F.col("_ok") == 1).drop("_ok")


# The link from a variant's stored coefficients to its dispersion.
DISPERSION_LINKS = {
    "constant": lambda b: F.exp(b),
    "variable": lambda b: F.lit(1.0) + F.exp(b),
    "var_unsmooth": lambda b: F.lit(1.0) + F.exp(b),
}


def linked_dispersion(coefs: DataFrame, cfg: CohortConfig, variant: str, basis: DataFrame | None = None) -> DataFrame:
    """Dispersion draws (Country, Sim, Age, Dispersion) of a variant from draws of its raw coefficients (Country, Sim, k,
    beta): one of the draw (constant, Age NULL), one per basis function (variable: the predictor is basis x beta; ``basis`` has
    (Country, Age_i, k, value)), or one per age (var_unsmooth: k is the age's number).  Poisson has none."""
    if variant not in DISPERSION_LINKS:
        raise ValueError(f"no dispersion in variant {variant!r}")
    link, age = DISPERSION_LINKS[variant], lambda k: (F.col(k) + F.lit(cfg.first_data_age - 1)).cast("int")
    if variant == "constant":
        return coefs.select("Country", "Sim", F.lit(None).cast("int").alias("Age"), link(F.col("beta")).alias("Dispersion"))
    if variant == "var_unsmooth":
        return coefs.select("Country", "Sim", age("k").alias("Age"), link(F.col("beta")).alias("Dispersion"))
    rows = coefs.join(basis, ["Country", "k"]).groupBy("Country", "Sim", "Age_i").agg(F.sum(F.col("value") * F.col("beta")).alias("eta"))
    return rows.select("Country", "Sim", age("Age_i").alias("Age"), link(F.col("eta")).alias("Dispersion"))


def dispersion_from_basis(basis: DataFrame, beta: DataFrame) -> DataFrame:
    """Dispersion at each observed age from spline coefficients,
    1 + exp(sum_k basis[age, k] * beta[k]); ``basis`` (Country, Age_i, k, value) is small
    (ages x basis functions): pass it through ``operators.small``; ``beta`` has the coefficient draws (Country, Sim, k, beta)."""
    j = beta.join(basis, ["Country", "k"])
    return j.groupBy("Country", "Sim", "Age_i").agg(
        (F.lit(1.0) + F.exp(F.sum(F.col("value") * F.col("beta")))).alias("Dispersion")
    )


def dispersion_by_age(long: DataFrame, cfg: CohortConfig) -> DataFrame:
    """H7: dispersion draws stored per parameter name (``dispersion[k]``, k the observed
    age index) -> (Country, Sim, Age, Dispersion) with Age = k + first_data_age - 1; a
    single unindexed ``dispersion`` (constant variant) keeps Age NULL (joins on Sim only)."""
    k = F.regexp_extract(F.col("param"), r"[0-9]+", 0)
    age = F.when(k == "", F.lit(None).cast("int")).otherwise(k.cast("int") + F.lit(cfg.first_data_age - 1))
    return long.filter(F.col("param").startswith("dispersion")).select(
        "Country", "Sim", age.alias("Age"), F.col("value").alias("Dispersion"))
