"""Comparator forecasters and their scoring (N1-N8, E1-E4, E8, E9, C2, C8, C9,
D6, D7, D11-D13, D20-D22, H3, H9).

All closed form: the reference's nest/map/unnest per country becomes grouped
aggregation keyed by Country (no per-country Python loop, no applyInPandas).
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CohortConfig, Windows
from ..functions.numeric import ieee_div, r_mean, r_weighted_mean

# The nine predictive quantiles of the freeze-slope comparator.
SLOPE_QUANTILES = (0.025, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.975)


def normal_quantiles() -> list[tuple[float, float]]:
    """(probability, standard normal quantile) pairs, computed on the driver (9 constants)."""
    nd = NormalDist()
    return [(q, nd.inv_cdf(q)) for q in SLOPE_QUANTILES]


def scalar(df: DataFrame, col: str):
    """One aggregate value (a one-row, one-column result) brought to the driver as a
    constant for the next plan — a number, never a data set."""
    row = df.select(col).first()
    return None if row is None else row[0]


# ---------------------------------------------------------------- N1 freeze rate
def freeze_forecast(rates: DataFrame, cfg: Windows, holdback: int | None = None) -> DataFrame:
    """Hold the jump-off rate of every (Country, Age) flat and compute pointwise errors.

    Jump_off = max(Year) per Country - holdback (E1); future cells (ages in the freeze
    range) LEFT JOIN jump-off rates (C2); errors as the reference (quirk X22)."""
    h = cfg.T_holdback if holdback is None else holdback
    lo, hi = cfg.freeze_ages
    # windows over the (small, cells-level) rates instead of a self-join: one pass
    r = cfg.attach(rates).withColumn("Jump_off", F.max("Year").over(Window.partitionBy("Country")) - F.lit(h))
    r = r.withColumn("Rate_freeze", F.max(F.when(F.col("Year") == F.col("Jump_off"), F.col("Rate")))
                     .over(Window.partitionBy("Country", "Age")))
    a = r.filter((F.col("Year") > F.col("Jump_off")) & (F.col("Age") >= lo) & (F.col("Age") <= hi))
    bias = F.col("Rate_freeze") - F.col("Rate")
    e_births = F.col("Rate_freeze") * F.col("Exposure")
    bias_b = e_births - F.col("Births")
    return a.select(
        "Country", "Year", "Age", "Cohort", "Births", "Exposure", "Rate", "Jump_off", "Rate_freeze",
        bias.alias("Bias_rate"),
        F.abs(bias).alias("AE_rate"),
        (bias * bias).alias("SE_rate"),
        ieee_div(F.abs(bias), F.col("Rate_freeze") + F.lit(1e-06)).alias("PE_rate"),
        e_births.alias("E_births"),
        bias_b.alias("Bias_births"),
        F.abs(bias_b).alias("AE_births"),
        ieee_div(F.abs(bias_b), F.col("Births")).alias("PE_births"),
        (bias_b * bias_b).alias("SE_births"),
    )


def error_aggregates() -> list:
    """Births-weighted and unweighted error summaries (R weighted.mean / mean rules)."""
    w = F.col("Births")
    return [
        r_weighted_mean(F.col("Bias_rate"), w).alias("WBias_rate"),
        r_weighted_mean(F.col("AE_rate"), w).alias("WAE_rate"),
        F.sqrt(r_weighted_mean(F.col("SE_rate"), w)).alias("WRMSE_rate"),
        r_weighted_mean(F.col("PE_rate"), w).alias("WPE_rate"),
        r_weighted_mean(F.col("E_births"), w).alias("WE_births"),
        r_weighted_mean(F.col("Bias_births"), w).alias("WBias_births"),
        r_weighted_mean(F.col("AE_births"), w).alias("WAE_births"),
        r_weighted_mean(F.col("PE_births"), w).alias("WPE_births"),
        F.sqrt(r_weighted_mean(F.col("SE_births"), w)).alias("WRMSE_births"),
        r_mean(F.col("Bias_rate")).alias("Bias_rate"),
        r_mean(F.col("AE_rate")).alias("AE_rate"),
        F.sqrt(r_mean(F.col("SE_rate"))).alias("RMSE_rate"),
        r_mean(F.col("PE_rate")).alias("PE_rate"),
        r_mean(F.col("E_births")).alias("E_births"),
        r_mean(F.col("Bias_births")).alias("Bias_births"),
        r_mean(F.col("AE_births")).alias("AE_births"),
        r_mean(F.col("PE_births")).alias("PE_births"),
        F.sqrt(r_mean(F.col("SE_births"))).alias("RMSE_births"),
    ]


def freeze_summary(assess: DataFrame) -> DataFrame:
    """D6 by Country."""
    return assess.groupBy("Country").agg(*error_aggregates())


def freeze_by_age(assess: DataFrame) -> DataFrame:
    """D7 by (Age, Country)."""
    return assess.groupBy("Age", "Country").agg(*error_aggregates())


# ---------------------------------------------------------- N2-N5 freeze slope
def slope_panel(rates: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Period ASFR panel restricted to the comparator's ages."""
    lo, hi = cfg.slope_ages
    return rates.filter((F.col("Age") >= lo) & (F.col("Age") <= hi)).select(
        "Country", "Year", "Age", F.col("Rate").alias("ASFR")
    )


def _year_positions(panel: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Position of every distinct year per country and the trend window positions."""
    years = panel.select("Country", "Year").distinct()
    w = Window.partitionBy("Country")
    return years.select(
        "Country",
        "Year",
        F.row_number().over(w.orderBy("Year")).alias("pos"),
        F.count(F.lit(1)).over(w).alias("n_years"),
    ).select(
        "*",
        (F.col("n_years") - F.lit(cfg.n_holdback)).alias("last_trend"),
        (F.col("n_years") - F.lit(cfg.n_holdback + cfg.n_trend - 1)).alias("first_trend"),
    )


def slope_fit_age(panel: DataFrame, cfg: CohortConfig) -> DataFrame:
    """N2 age part (E3, E4): ax = ASFR at the last trend year, bx = endpoint slope."""
    pos = _year_positions(panel, cfg)
    p = panel.join(pos, ["Country", "Year"])  # tiny: AQE broadcasts it on measured size
    last = F.max(F.when(F.col("pos") == F.col("last_trend"), F.col("ASFR")))
    first = F.max(F.when(F.col("pos") == F.col("first_trend"), F.col("ASFR")))
    return p.groupBy("Country", "Age").agg(
        last.alias("ax"), ((last - first) / F.lit(float(cfg.n_trend - 1))).alias("bx")
    )


def slope_fit_time(panel: DataFrame, cfg: CohortConfig, with_step: bool = False) -> DataFrame:
    """N2 time part (D22, E2): per trend year kt = sum(bx (ASFR - ax)) / sum(bx^2);
    epsilon = diff(kt) - 1.  Any missing matrix cell makes the year's kt NULL (R NA)."""
    pos = _year_positions(panel, cfg)
    fit = slope_fit_age(panel, cfg)
    den = fit.groupBy("Country").agg(
        F.sum(F.col("bx") * F.col("bx")).alias("bxbx"),
        F.count("bx").alias("n_bx"),
        F.count(F.lit(1)).alias("n_ages"),
    )
    trend = panel.join(pos, ["Country", "Year"]).filter(
        (F.col("pos") >= F.col("first_trend")) & (F.col("pos") <= F.col("last_trend"))
    )
    t = trend.join(fit, ["Country", "Age"]).groupBy("Country", "Year").agg(
        F.sum(F.col("bx") * (F.col("ASFR") - F.col("ax"))).alias("num"),
        F.count(F.col("bx") * (F.col("ASFR") - F.col("ax"))).alias("n_num"),
    )
    t = t.join(den, "Country")
    kt = F.when(
        (F.col("n_num") == F.col("n_ages")) & (F.col("n_bx") == F.col("n_ages")),
        ieee_div(F.col("num"), F.col("bxbx")),
    )
    t = t.select("Country", "Year", kt.alias("kt"))
    w = Window.partitionBy("Country").orderBy("Year")
    out = t.select(
        "Country", "Year", "kt",
        (F.col("kt") - F.lag("kt").over(w) - F.lit(1.0)).alias("epsilon"),
        F.row_number().over(w).alias("step"),
    )
    return out if with_step else out.drop("step")


def slope_sigma2(fit_time: DataFrame) -> DataFrame:
    """N3 (D21): pooled sample variance of all innovations (one row); a missing
    innovation makes it NULL, as R's ``var`` without ``na.rm``."""
    eps = fit_time.filter(F.col("step") > 1)
    return eps.agg(
        F.when(F.count("epsilon") < F.count(F.lit(1)), F.lit(None).cast("double"))
        .otherwise(F.var_samp("epsilon")).alias("sigma2"),
        F.count(F.lit(1)).alias("n_epsilon"),
    )


def slope_quantiles(panel: DataFrame, cfg: CohortConfig) -> DataFrame:
    """N4 (E8, C14, H14, I10, I22): predictive quantiles for horizons 1..n_predict."""
    fit = slope_fit_age(panel, cfg)
    sig = slope_sigma2(slope_fit_time(panel, cfg, with_step=True))
    jo = panel.groupBy("Country").agg((F.max("Year") - F.lit(cfg.n_predict)).alias("jo"))
    qz = F.array(*[F.struct(F.lit(q).alias("Quantile"), F.lit(z).alias("z")) for q, z in normal_quantiles()])
    sigma2 = scalar(sig, "sigma2")  # pooled innovation variance (N3), a single number
    f = fit.join(jo, "Country").withColumn("sigma2", F.lit(sigma2).cast("double"))
    f = f.select("*", F.explode(F.sequence(F.lit(1), F.lit(cfg.n_predict))).alias("h"))
    kt = F.least(F.col("h"), F.lit(cfg.n_extrapolate)).cast("double")
    s2 = F.col("sigma2")
    rate = F.col("ax") + F.col("bx") * kt
    var = F.col("bx") * F.col("bx") * (kt * kt * s2 / F.lit(float(cfg.n_trend - 1)) + F.col("h") * s2)
    f = f.select("Country", "Age", (F.col("jo") + F.col("h")).alias("Year"), rate.alias("rate"), var.alias("var"),
                 F.explode(qz).alias("q"))
    return f.select(
        "Country",
        "Age",
        "Year",
        F.col("q.Quantile").alias("Quantile"),
        (F.col("rate") + F.sqrt("var") * F.col("q.z")).alias("ASFR"),
        (F.abs(F.col("q.Quantile") - F.lit(0.5)) * F.lit(2.0)).alias("Interval"),
    )


def slope_assess(panel: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Observed LEFT JOIN predictions (1 -> 9 fan-out), then drop_na."""
    pred = slope_quantiles(panel, cfg).withColumnRenamed("ASFR", "ASFR_predictions")
    j = panel.join(pred, ["Country", "Age", "Year"], "left")
    j = j.dropna("any")
    for c in ("ASFR", "ASFR_predictions", "Quantile", "Interval"):
        j = j.filter(~F.isnan(c))
    return j


def slope_rmse(panel: DataFrame, cfg: CohortConfig) -> DataFrame:
    """RMSE of the median forecast by Country."""
    a = slope_assess(panel, cfg).filter(F.abs(F.col("Quantile") - F.lit(0.5)) < F.lit(0.01))
    se = (F.col("ASFR_predictions") - F.col("ASFR")) ** 2
    return a.groupBy("Country").agg(F.sqrt(F.avg(se)).alias("RMSE"))


def slope_coverage(panel: DataFrame, cfg: CohortConfig) -> DataFrame:
    """D13 + H3 + H9: quantiles pivoted to columns, strict interval hits, share by Country,
    then unpivoted to (Country, Interval, Proportion)."""
    a = slope_assess(panel, cfg)

    def q(p):
        return F.max(F.when(F.col("Quantile") == F.lit(p), F.col("ASFR_predictions")))

    wide = a.groupBy("Country", "Year", "Age", "ASFR").agg(
        q(0.025).alias("Q2_5"), q(0.05).alias("Q5"), q(0.1).alias("Q10"), q(0.25).alias("Q25"),
        q(0.75).alias("Q75"), q(0.9).alias("Q90"), q(0.95).alias("Q95"), q(0.975).alias("Q97_5"),
    )
    x = F.col("ASFR")

    def hit(lo, hi):
        return ((x > F.col(lo)) & (x < F.col(hi))).cast("double")

    cov = wide.groupBy("Country").agg(
        F.avg(hit("Q25", "Q75")).alias("I50"),
        F.avg(hit("Q10", "Q90")).alias("I80"),
        F.avg(hit("Q5", "Q95")).alias("I90"),
        F.avg(hit("Q2_5", "Q97_5")).alias("I95"),
    )
    return cov.unpivot("Country", ["I50", "I80", "I90", "I95"], "Interval", "Proportion")


# ---------------------------------------------------- N6-N8 third comparator
def interval_scores(post: DataFrame) -> DataFrame:
    """N6 + N7 + D11: strict percentile interval hits and RMSE on held-back cells."""
    se = (F.col("ASFR_prediction") - F.col("ASFR")) ** 2
    i90 = ((F.col("ASFR") < F.col("p95")) & (F.col("ASFR") > F.col("p5"))).cast("double")
    i50 = ((F.col("ASFR") < F.col("p75")) & (F.col("ASFR") > F.col("p25"))).cast("double")
    return post.filter(~F.col("V_ind")).groupBy("Country").agg(
        F.sqrt(F.avg(se)).alias("RMSE"), F.avg(i90).alias("I90"), F.avg(i50).alias("I50")
    )


def calibration_panel(asfr: DataFrame, expos: DataFrame, cfg: CohortConfig, start_cohort: int | None = None) -> DataFrame:
    """N8 + C8: ASFR panel LEFT JOIN exposure panel, restricted to cohorts and ages."""
    start = cfg.first_full_cohort if start_cohort is None else start_cohort
    lo, hi = cfg.slope_ages
    keys = ["Country", "Cohort", "ARDY", "Year"]
    a = asfr.filter((F.col("Cohort") >= start) & F.col("ARDY").between(lo, hi))
    return a.join(expos.select(*keys, "Exposure"), keys, "left")


def last_complete_cohort(panel: DataFrame, cfg: CohortConfig) -> DataFrame:
    """E9 + D20: largest cohort with every age of the range observed, and range probes."""
    lo, hi = cfg.slope_ages
    per = panel.groupBy("Country", "Cohort").agg(F.countDistinct("ARDY").alias("n_ages"))
    return per.groupBy("Country").agg(
        F.min("Cohort").alias("first_cohort"),
        F.max("Cohort").alias("last_cohort"),
        F.sum("n_ages").alias("n_cells"),
        F.max("n_ages").alias("max_ages_per_cohort"),
        F.max(F.when(F.col("n_ages") == F.lit(hi - lo + 1), F.col("Cohort"))).alias("last_complete_cohort"),
    )
