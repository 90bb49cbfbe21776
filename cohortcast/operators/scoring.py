"""Forecast scoring on posterior draws.

Pipeline: rate draws (narrow) -> per-draw dispersion (co-partitioned join on
Country, Sim) -> observed cells (size-checked broadcast) -> per-cell summaries.
The per-cell aggregates (log-mean-exp, averages, predictive rank) are partial
aggregations: only cell-level partial states cross the network.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CohortConfig
from ..functions import special
from ..functions.numeric import hash_uniform, ieee_div, lit_d, ln, nb_lpmf, r_mean
from .draws import rate_draws
from .likelihood import dispersion_at, dispersion_maps
from .logmean import log_mean_exp

CELL = ["Country", "Age", "Cohort"]


def predictive_table(draws: DataFrame, dispersion: DataFrame, observed: DataFrame, cfg: CohortConfig,
                     param_func: tuple[str, str] | None = None, age_filter=None, draw_filter=None) -> DataFrame:
    """K1 (C6, C7, C15, B16): rate draws with the draw's dispersion at that age (rows
    without dispersion dropped), LEFT JOIN the observed cell, E_births = Rate * Exposure.

    ``observed`` holds (Country, Year, Age, Cohort, Births, Exposure, Rate)."""
    d = draws if draw_filter is None else draws.filter(draw_filter)
    # co-partitioned on (Country, Sim); the maps are the build side
    d = d.join(dispersion_maps(dispersion).hint("shuffle_hash"), ["Country", "Sim"])
    r = rate_draws(d, cfg, param_func, keep=["dmap", "disp_const"], age_filter=age_filter)
    r = r.select("*", dispersion_at(F.col("Age")).alias("Dispersion")).drop("dmap", "disp_const")
    r = r.filter(F.col("Dispersion").isNotNull() & ~F.isnan("Dispersion") & ~F.isnan("Rate")
                 & ~F.isnan("Comp_1") & ~F.isnan("Comp_2"))
    # Year = Cohort + Age on the rate side, so unobserved (future) cells keep their Year
    obs = observed.select("Country", "Cohort", "Age", "Births", "Exposure", F.col("Rate").alias("Obs_rate"))
    j = r.join(obs, ["Country", "Cohort", "Age"], "left")
    return j.select("Country", "Sim", "Cohort", "Age", "Comp_1", "Comp_2", "Rate", "Dispersion",
                    (F.col("Cohort") + F.col("Age")).cast("int").alias("Year"), "Births", "Exposure", "Obs_rate",
                    (F.col("Rate") * F.col("Exposure")).alias("E_births"))


def forecast_filter(cfg: CohortConfig):
    """B13 pushed before the densities: held-back cells, jump-off < Year <= last observed
    year (Year = Cohort + Age).  Cells beyond the last year have no exposure and every
    scoring operator drops them, so their densities are never computed."""
    return lambda age: (F.col("Cohort") + age > F.lit(cfg.jump_off)) & (F.col("Cohort") + age <= F.lit(cfg.last_year))


def forecast_draws(cfg: CohortConfig):
    """The same filter at draw level (before the age explode)."""
    return ((F.col("Cohort") + F.lit(cfg.maximum_age) > F.lit(cfg.jump_off))
            & (F.col("Cohort") + F.lit(cfg.minimum_age) <= F.lit(cfg.last_year)))


def pointwise_scores(pred: DataFrame, cfg: CohortConfig) -> DataFrame:
    """K4 draw level: NB log score of the rounded observed births (B11) with the draw's
    mean and dispersion, on forecast cells with non-zero exposure (B13, quirk X13)."""
    a = pred.filter((F.col("Year") > cfg.jump_off) & F.col("Exposure").isNotNull() & (F.col("Exposure") != 0))
    return a.select(
        *CELL, "Year", "Sim",
        nb_lpmf(F.bround("Births"), F.col("E_births"), F.col("Dispersion")).alias("Score"),
        (F.col("E_births") + F.col("E_births") * F.col("E_births") / F.col("Dispersion")).alias("Var_births"),
    )


def cell_log_score(pred: DataFrame, cfg: CohortConfig) -> DataFrame:
    """K4 cell level: log-mean-exp of the draw scores per cell."""
    s = pointwise_scores(pred, cfg)
    return log_mean_exp(s, CELL + ["Year"], {"Score": F.col("Score")})


@F.pandas_udf(T.DoubleType())
def _nb_cdf_udf(y: pd.Series, mu: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(special.nb_cdf(y.to_numpy(dtype=float, na_value=np.nan), mu.to_numpy(dtype=float, na_value=np.nan),
                                     k.to_numpy(dtype=float, na_value=np.nan)))


def nb_cdf(y, mu, k):
    """P(Y <= y) for NB(mean mu, size k) = I_{k/(k+mu)}(k, y+1) (K2, exact, no sampling).

    An Arrow-batched pandas UDF: the regularised incomplete beta is an iterative
    continued fraction, O(100) vectorised numpy steps per batch whatever the count."""
    return _nb_cdf_udf(y.cast("double"), mu.cast("double"), k.cast("double"))


def predictive_rank(pred: DataFrame, cfg: CohortConfig) -> DataFrame:
    """K2: Q = mean over draws of P(PP <= Births | mu, size) on forecast cells with exposure."""
    a = pred.filter((F.col("Year") > cfg.jump_off) & F.col("Exposure").isNotNull())
    p = a.select(*CELL, "Year", "Births",
                 nb_cdf(F.floor("Births"), F.col("E_births"), F.col("Dispersion")).alias("cdf"))
    return p.groupBy(*CELL, "Year").agg(F.max("Births").alias("Births"), F.avg("cdf").alias("Q"))


def central_errors(pred: DataFrame, cfg: CohortConfig) -> DataFrame:
    """K5 pointwise (D3): per cell draw averages (Log_rate is log of the averaged rate,
    rule 8.9), exact predictive rank Q, and the error measures."""
    a = pred.filter((F.col("Year") > cfg.jump_off) & F.col("Exposure").isNotNull())
    a = a.withColumn("cdf", nb_cdf(F.floor("Births"), F.col("E_births"), F.col("Dispersion")))
    cdf = F.col("cdf")
    c = a.groupBy(*CELL).agg(
        r_mean(F.col("Rate")).alias("Rate"),
        r_mean(F.col("E_births")).alias("E_births"),
        F.max("Obs_rate").alias("Obs_rate"),
        F.max("Births").alias("Births"),
        F.max("Exposure").alias("Exposure"),
        F.avg(cdf).alias("Q"),
    )
    bias = F.col("Rate") - F.col("Obs_rate")
    bias_b = F.col("E_births") - F.col("Births")
    return c.select(
        *CELL, "Rate", ln(F.col("Rate")).alias("Log_rate"), "E_births", "Obs_rate", "Births", "Exposure", "Q",
        bias.alias("Bias_rate"), F.abs(bias).alias("AE_rate"),
        ieee_div(F.abs(bias), F.col("Rate")).alias("PE_rate"), (bias * bias).alias("SE_rate"),
        bias_b.alias("Bias_births"), F.abs(bias_b).alias("AE_births"),
        ieee_div(F.abs(bias_b), F.col("E_births")).alias("PE_births"), (bias_b * bias_b).alias("SE_births"),
    )


def error_summary(errors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """K5 summary (D4 inclusive coverage bounds, D5 means; R NA rule)."""
    keys = keys or ["Country"]
    q = F.col("Q")

    def cover(lo, hi):
        return F.avg(((q >= lo) & (q <= hi)).cast("double"))

    return errors.groupBy(*keys).agg(
        cover(0.05, 0.95).alias("Q_90"), cover(0.10, 0.90).alias("Q_80"), cover(0.25, 0.75).alias("Q_50"),
        r_mean(F.col("Bias_rate")).alias("Bias_rate"), r_mean(F.col("AE_rate")).alias("AAE_rate"),
        r_mean(F.col("PE_rate")).alias("APE_rate"), F.sqrt(r_mean(F.col("SE_rate"))).alias("RMSE_rate"),
        r_mean(F.col("Bias_births")).alias("Bias_births"), r_mean(F.col("AE_births")).alias("AAE_births"),
        r_mean(F.col("PE_births")).alias("APE_births"), F.sqrt(r_mean(F.col("SE_births"))).alias("RMSE_births"),
    )


# --- K3: sampled predictive draws ------------------------------------------------
@F.pandas_udf(T.LongType())
def _nb_draws(u: pd.Series, mu: pd.Series, k: pd.Series) -> pd.Series:
    y = pd.Series(special.nb_quantile(u, mu, k))
    return y.astype("Int64")


def predictive_sampled(pred: DataFrame, cfg: CohortConfig) -> DataFrame:
    """K3 + I9: one negative-binomial draw per (draw, cell): the quantile of its distribution at a number that a digest of
    (seed, Country, Sim, Cohort, Age) gives, so that nothing is grouped or sorted and any partitioning, retry or engine draws
    the same.  Cells without exposure have none."""
    u = hash_uniform(0, cfg.seed, F.col("Country"), F.col("Sim"), F.col("Cohort"), F.col("Age"))
    cols = pred.select("Country", "Sim", "Cohort", F.col("Age").cast("int").alias("Age"), "E_births", "Dispersion", "Exposure", u.alias("u"))
    out = cols.withColumn("PP_births", _nb_draws("u", "E_births", "Dispersion"))
    return out.select("Country", "Sim", "Cohort", "Age", "E_births", "Dispersion", "PP_births",
                      ieee_div(F.col("PP_births"), F.col("Exposure")).alias("PP_rate"))
