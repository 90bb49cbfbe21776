"""Leave-one-out and leave-k-out bookkeeping.

* M2 (plain importance-sampling LOO) and D10 (log-mean-exp lpd) are one-pass
  partial aggregations keyed by (run, observation).
* M1 (PSIS) sorts and fits the draws of many observations at once, as the rows of a
  matrix (``psis.py``); a row holds the draws of one observation.
* M7 (fold search) and C17 (nearest left-out points) are in ``folds.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CohortConfig
from . import psis
from .logmean import log_mean_exp
from .small import small_side


def is_loo(ll: DataFrame, keys: tuple[str, ...] = ("Country",)) -> DataFrame:
    """M2: lpd_i = log mean exp(ll), elpd_is_i = -log mean exp(-ll), p_is_i = lpd - elpd."""
    k = list(keys) + ["i"]
    r = log_mean_exp(ll, k, {"lpd": F.col("ll"), "neg": -F.col("ll")})
    return r.select(*k, "lpd", (-F.col("neg")).alias("elpd_is"), (F.col("lpd") + F.col("neg")).alias("p_is"), "n_draws")


def lpd_points(ll: DataFrame, points: DataFrame, keys: tuple[str, ...] = ("Country",)) -> DataFrame:
    """Log predictive density of the left-out points under the refit's draws."""
    k = list(keys) + ["i"]
    sel = ll.join(small_side(points.select(*k).distinct()), k)
    r = log_mean_exp(sel, k, {"lpd": F.col("ll")})
    return r.select(*keys, F.col("i").alias("ll_ind"), "lpd")


def loo_summary(pointwise: DataFrame, elpd_col: str, keys: tuple[str, ...] = ("Country",),
                p_col: str | None = None, k_col: str | None = None, k_threshold: float = 0.7) -> DataFrame:
    """Summary of a pointwise LOO table: elpd, its SE sqrt(n var), p, looic, looic SE, high-k count."""
    e = F.col(elpd_col)
    aggs = [
        F.sum(e).alias("elpd_loo"),
        F.sqrt(F.count(e) * F.var_samp(e)).alias("elpd_se"),
        (F.lit(-2.0) * F.sum(e)).alias("looic"),
        (F.lit(2.0) * F.sqrt(F.count(e) * F.var_samp(e))).alias("looic_se"),
        F.count(F.lit(1)).alias("n_obs"),
    ]
    if p_col:
        aggs.append(F.sum(p_col).alias("p_loo"))
    if k_col:
        aggs.append(F.count(F.when(F.col(k_col) > k_threshold, 1)).alias("n_high_pareto_k"))
    return pointwise.groupBy(*keys).agg(*aggs)


# ---------------------------------------------------------------- M1 PSIS
def psis_loo(ll: DataFrame, keys: tuple[str, ...] = ("Country",)) -> DataFrame:
    """M1: PSIS-LOO pointwise (elpd, p, looic, Pareto k, relative efficiency) per (run, observation)."""
    return psis.over_draws(ll, [*keys, "i"], "ll", ["elpd_loo", "p_loo", "looic", "pareto_k", "r_eff"], psis.loo_rows)


# ---------------------------------------------------------------- M5-M8
def loo_diagnostics(pointwise: DataFrame, obs: DataFrame, cfg: CohortConfig, keys: tuple[str, ...] = ("Country",)) -> DataFrame:
    """M5 + M6: Pareto k with the observation's age and cohort; flag of points to refit."""
    j = pointwise.join(obs.select("Country", "i", "Age", "Cohort"), ["Country", "i"])
    return j.select(*keys, "i", "Age", "Cohort", "pareto_k",
                    (F.col("pareto_k") > cfg.pareto_k_threshold).alias("refit"))


def lko_runs(folds: DataFrame, model: str | Column = "model1", dispersion: str = "variable",
             keys: tuple[str, ...] = ("Country",)) -> DataFrame:
    """M8 + D30: one refit run per (run, fold) with its indices joined by '_' in numeric order."""
    g = folds.groupBy(*keys, "fold").agg(F.array_sort(F.collect_list("i")).alias("idx"))
    return g.select(
        F.lit(model).alias("Model"), *keys, "fold",
        F.concat_ws("_", F.transform("idx", lambda x: x.cast("string"))).alias("inds"),
        F.size("idx").alias("n_points"), F.lit(dispersion).alias("dispersion"),
    ).filter(F.col("inds") != "")


def corrected_psis(pointwise: DataFrame, refit: DataFrame, eligible: DataFrame, cfg: CohortConfig,
                   keys: tuple[str, ...] = ("Country",)) -> DataFrame:
    """M4 + M11 (C19): PSIS summary of every run with its corrected LOOIC: NULL for an ineligible run (M3), the stored
    one without high-k points, else with the refit lpd of the run's points; the SE is that of PSIS (quirk X9)."""
    s = loo_summary(pointwise, "elpd_loo", keys, p_col="p_loo", k_col="pareto_k", k_threshold=cfg.pareto_k_threshold)
    c = corrected_looic(pointwise, "elpd_loo", refit, keys).select(*keys, "n_refit", F.col("looic").alias("refitted"), "looic_se_recomputed")
    j = s.join(c, list(keys)).join(eligible, "Country")
    ok = F.col("loo_eligible")
    return j.select(*keys, "loo_eligible", "n_obs", "n_high_pareto_k", "n_refit",
                    *[F.when(ok, F.col(c)).alias(c) for c in ("elpd_loo", "elpd_se", "p_loo", "looic", "looic_se")],
                    F.when(ok, F.when(F.col("n_high_pareto_k") == 0, F.col("looic")).otherwise(F.col("refitted")))
                    .alias("looic_corrected"), F.when(ok, F.col("looic_se_recomputed")).alias("looic_se_recomputed"))


def corrected_looic(pointwise: DataFrame, elpd_col: str, refit: DataFrame, keys: tuple[str, ...] = ("Country",)) -> DataFrame:
    """M11 (C18, D27, quirk X9): replace the pointwise elpd of refitted points by their
    refit lpd, LOOIC = -2 sum(elpd); the stored SE is kept and the recomputed one added."""
    k = list(keys)
    pw = pointwise.select(*k, "i", elpd_col)
    j = pw.join(small_side(refit.withColumnRenamed("ll_ind", "i")), k + ["i"], "left")
    e0, e1 = F.col(elpd_col), F.coalesce(F.col("lpd"), F.col(elpd_col))
    return j.groupBy(*k).agg(
        F.count(F.col("lpd")).alias("n_refit"),
        (F.lit(-2.0) * F.sum(e1)).alias("looic"),
        (F.lit(2.0) * F.sqrt(F.count(e0) * F.var_samp(e0))).alias("looic_se"),
        (F.lit(2.0) * F.sqrt(F.count(e1) * F.var_samp(e1))).alias("looic_se_recomputed"),
        (F.lit(-2.0) * F.sum(e0)).alias("looic_uncorrected"),
    )
