"""Posterior reconstruction.

Design: the draws are kept *wide* (one row per Country, Sim, time point, all
parameters as columns), so the reference's three joins that reassemble one draw
(mode gap with mode sum, modes with sds, components with level and mixture) do
not exist here.  The age schedule is an ``explode(sequence(1, n_ages))`` followed
by projections: a narrow pipeline with no shuffle, whatever the number of draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CohortConfig
from ..functions import densities as dens
from ..functions.numeric import inv_logit
from .small import small_side

DRAW_KEYS = ["Country", "Sim"]
PARAM_COLUMNS = ["CEB", "mode_age_gap", "mode_age_sum", "sd_1", "sd_2", "logit_mixture"]

# parameter-name pattern: family[idx1] or family[idx1,idx2]
NAME_RE = r"^(\w+)\[(\d+)(?:,(\d+))?\]$"


def time_index(cfg: CohortConfig, axis: str = "Cohort"):
    """B19 inverse: calendar time -> 1-based parameter index."""
    return F.col(axis) - F.lit(cfg.start_time - 1)


def draws_long(draws: DataFrame, cfg: CohortConfig, axis: str = "Cohort") -> DataFrame:
    """Wide draws -> one row per (draw, parameter name) with sampler-style
    names (``CEB[3]``, ``sd_age[2,17]``)."""
    ids = [c for c in ("Country", "Sim", "Chain", "Iter", axis) if c in draws.columns]
    long = draws.unpivot(ids, PARAM_COLUMNS, "var", "value")
    t = time_index(cfg, axis).cast("string")
    name = (
        F.when(F.col("var") == "sd_1", F.concat(F.lit("sd_age[1,"), t, F.lit("]")))
        .when(F.col("var") == "sd_2", F.concat(F.lit("sd_age[2,"), t, F.lit("]")))
        .otherwise(F.concat(F.col("var"), F.lit("["), t, F.lit("]")))
    )
    return long.select(*[c for c in ids if c != axis], name.alias("param"), "value")


def parse_param_names(df: DataFrame, col: str = "param") -> DataFrame:
    """H10 + I16: split ``family[i]`` / ``family[i,j]`` into Family, idx1, idx2, rank;
    any other rank raises at run time (no extra job for the check)."""
    p = F.col(col)
    fam = F.regexp_extract(p, NAME_RE, 1)
    i1 = F.regexp_extract(p, NAME_RE, 2)
    i2 = F.regexp_extract(p, NAME_RE, 3)
    rank = F.when(fam == "", F.raise_error(F.concat(F.lit("parameter has an unsupported shape: "), p))).otherwise(
        F.when(i2 == "", F.lit(1)).otherwise(F.lit(2))
    )
    return df.select(
        "*",
        F.regexp_replace(p, r"\[[0-9]{1,},*[0-9]*\]", "").alias("Family"),
        i1.cast("int").alias("idx1"),
        F.when(i2 == "", F.lit(None).cast("int")).otherwise(i2.cast("int")).alias("idx2"),
        rank.alias("rank"),
    )


def extract_2d(long: DataFrame, family: str, index_1: str, index_2: str, value: str,
               conv_1=lambda c: c, conv_2=lambda c: c) -> DataFrame:
    """One 2-d parameter family as (keys, index_1, index_2, value) with index converters."""
    p = parse_param_names(long.filter(F.col("param").startswith(family + "[")))
    keys = [c for c in long.columns if c not in ("param", "value")]
    return p.filter(F.col("rank") == 2).select(
        *keys, conv_1(F.col("idx1")).alias(index_1), conv_2(F.col("idx2")).alias(index_2), F.col("value").alias(value)
    )


def pivot_sd(long: DataFrame, cfg: CohortConfig, axis: str = "Cohort") -> DataFrame:
    """J7 + H2: spread the component sds back to columns Sd_1, Sd_2 (quirk X19: the
    library's ``x + start - 1`` index shift)."""
    sd = extract_2d(long, "sd_age", "Component", axis, "Sd",
                    conv_2=lambda c: c + F.lit(cfg.start_time - 1))
    keys = [c for c in sd.columns if c not in ("Component", "Sd", "Chain", "Iter")]
    return sd.groupBy(*keys).agg(
        F.max(F.when(F.col("Component") == 1, F.col("Sd"))).alias("Sd_1"),
        F.max(F.when(F.col("Component") == 2, F.col("Sd"))).alias("Sd_2"),
    )


def on_time_axis(draws: DataFrame, runs: DataFrame, first_index: int) -> DataFrame:
    """J3 + B20: draws whose ``Cohort`` counts time points from ``first_index``, put on each run's own axis.

    ``runs`` (Country, time_dimension, start_time, T_total) says where the axis of a run begins and how many points it
    has; the calendar time of point t is start_time + t - 1, a cohort or a year.  Cohort and period runs are one table:
    (Country, time_dimension, Time, level: ``CEB`` or ``TFR``, and the parameters)."""
    t = F.col("Cohort") - F.lit(first_index) + F.lit(1)
    j = draws.join(small_side(runs.select("Country", "time_dimension", "start_time", "T_total")), "Country").filter(t <= F.col("T_total"))
    return j.select("Country", "Sim", "time_dimension", (F.col("start_time") + t - 1).cast("long").alias("Time"),
                    F.when(F.col("time_dimension") == "Cohort", "CEB").otherwise("TFR").alias("level"), *PARAM_COLUMNS)


def locations(draws: DataFrame, axis: str = "Cohort") -> DataFrame:
    """Component locations from the mode sum and gap."""
    return draws.select(
        "Country", "Sim", axis,
        (F.lit(0.5) * (F.col("mode_age_sum") - F.col("mode_age_gap"))).alias("Mode_1"),
        (F.lit(0.5) * (F.col("mode_age_sum") + F.col("mode_age_gap"))).alias("Mode_2"),
    )


def mixture_weight(draws: DataFrame, cfg: CohortConfig, axis: str = "Cohort") -> DataFrame:
    """J5 + J8 (+ quirk X4): level (CEB on the cohort axis, TFR on the period axis) and
    mixture weight inv_logit(logit_mixture)."""
    level = "CEB" if axis == "Cohort" else "TFR"
    return draws.select("Country", "Sim", axis, F.col("CEB").alias(level),
                        inv_logit(F.col("logit_mixture")).alias("Mixture"))


def rate_draws(draws: DataFrame, cfg: CohortConfig, param_func: tuple[str, str] | None = None,
               axis: str = "Cohort", keep: list[str] | None = None, age_filter=None, cells: DataFrame | None = None,
               pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rate schedule of every draw on the model age grid.

    ``cells`` (Country, the axis, Age and other columns, which are kept) takes the schedule at these cells alone: a small
    side, joined before the densities.  ``pairs`` takes every draw under each of these pairs of density names (columns
    ``p1``, ``p2``): a density is evaluated once per component, whatever the number of pairs that hold it.

    Per draw (before the explode): locations, mixture weight and the density
    constants.  Per (draw, age): x = a - 0.5 (B18), Comp_1 = CEB psi f1, Comp_2 =
    CEB (1 - psi) f2, Rate = Comp_1 + Comp_2, Age = a + minimum_age - 1."""
    keep = keep or []
    by_column = param_func is None and "p1" in keep and "p2" in keep
    f1, f2 = param_func or cfg.param_func
    amin = cfg.minimum_age
    psi = inv_logit(F.col("logit_mixture"))
    base = draws.select(
        "Country", "Sim", axis, *keep,
        (F.col("CEB") * psi).alias("w1"),
        (F.col("CEB") * (F.lit(1.0) - psi)).alias("w2"),
        (F.lit(0.5) * (F.col("mode_age_sum") - F.col("mode_age_gap")) - F.lit(float(amin))).alias("l1"),
        (F.lit(0.5) * (F.col("mode_age_sum") + F.col("mode_age_gap")) - F.lit(float(amin))).alias("l2"),
        "sd_1", "sd_2",
    )
    if pairs is not None:
        names = [[*dict.fromkeys(p[k] for p in pairs)] for k in (0, 1)]
        each = [(k, n, f"g{k}_{n}") for k in (1, 2) for n in names[k - 1]]
        stage1 = base.select("Country", "Sim", axis, *keep, "w1", "w2",
                             *[c for k, n, g in each for c in dens.prepare(n, F.col(f"l{k}"), F.col(f"sd_{k}"), g)])
        per_draw = stage1.select("*", *[dens.finish(n, g) for _, n, g in each])
    elif by_column:  # density names are columns p1/p2 (several models in one job)
        n1, n2 = F.col("p1"), F.col("p2")
        stage1 = base.select(
            "Country", "Sim", axis, *keep, "w1", "w2",
            *dens.prepare_by(n1, F.col("l1"), F.col("sd_1"), "g1"),
            *dens.prepare_by(n2, F.col("l2"), F.col("sd_2"), "g2"),
        )
        per_draw = stage1.select("*", dens.finish_by(n1, "g1"), dens.finish_by(n2, "g2"))
    else:
        stage1 = base.select(
            "Country", "Sim", axis, *keep, "w1", "w2",
            *dens.prepare(f1, F.col("l1"), F.col("sd_1"), "g1"),
            *dens.prepare(f2, F.col("l2"), F.col("sd_2"), "g2"),
        )
        per_draw = stage1.select("*", dens.finish(f1, "g1"), dens.finish(f2, "g2"))
    beside = [c for c in cells.columns if c not in ("Country", axis, "Age")] if cells is not None else []
    if cells is None:
        ages = per_draw.select("*", F.explode(F.sequence(F.lit(1), F.lit(cfg.n_ages))).alias("a"))
    else:
        at = cells.filter(F.col("Age").between(amin, cfg.maximum_age))
        ages = per_draw.join(at.select("Country", axis, *beside, (F.col("Age") - F.lit(amin - 1)).alias("a")), ["Country", axis])
    if age_filter is not None:
        ages = ages.filter(age_filter(F.col("a") + F.lit(amin - 1)))
    x = F.col("a").cast("double") - F.lit(0.5)
    if pairs is not None:
        key = ["Country", "Sim", axis, *keep, *beside, "Age"]
        comps = ages.select(*key[:-1], (F.col("a") + F.lit(amin - 1)).alias("Age"),
                            *[(F.col(f"w{k}") * dens.evaluate(n, x, g)).alias(f"c{g}") for k, n, g in each])
        rows = [F.struct(F.lit(a).alias("p1"), F.lit(b).alias("p2"), F.col(f"cg1_{a}").alias("Comp_1"), F.col(f"cg2_{b}").alias("Comp_2")) for a, b in pairs]
        out = comps.select(*key, F.explode(F.array(*rows)).alias("m")).select(*key, "m.*")
        return out.withColumn("Rate", F.col("Comp_1") + F.col("Comp_2"))
    if by_column:
        comp_1 = F.col("w1") * dens.evaluate_by(F.col("p1"), x, "g1")
        comp_2 = F.col("w2") * dens.evaluate_by(F.col("p2"), x, "g2")
    else:
        comp_1 = F.col("w1") * dens.evaluate(f1, x, "g1")
        comp_2 = F.col("w2") * dens.evaluate(f2, x, "g2")
    out = ages.select(
        "Country", "Sim", axis, *keep, *beside,
        (F.col("a") + F.lit(amin - 1)).alias("Age"),
        comp_1.alias("Comp_1"),
        comp_2.alias("Comp_2"),
    )
    return out.withColumn("Rate", F.col("Comp_1") + F.col("Comp_2"))


COMPONENT_LABELS = {"Comp_1": "Component One", "Comp_2": "Component Two", "Rate": "Rate"}


def exact_quantiles(wide: DataFrame, keys: list[str], columns: dict[str, str], probs: list[float], name: str,
                    value: str) -> DataFrame:
    """Exact type-7 quantiles of several columns per group: one row per group, column (labelled ``columns[c]`` in
    ``name``) and probability.

    A row is shuffled once with all of its columns; each group sorts one array per column (a group is the draws of one
    cell, bounded by the draws per run), and only the quantiles are laid out one below the other."""
    g = wide.groupBy(*keys).agg(*(F.sort_array(F.collect_list(c)).alias(c) for c in columns))
    ps = F.array(*[F.lit(p) for p in probs])

    def of(column: str):
        a = F.col(column)
        last = F.size(a) - 1

        def at(p):
            h = p * last
            low = F.floor(h).cast("int")
            left = F.get(a, low)
            return F.struct(p.alias("p"), (left + (h - low) * (F.get(a, F.least(low + 1, last)) - left)).alias("q"))

        return F.struct(F.lit(columns[column]).alias("name"), F.transform(ps, at).alias("qs"))

    parts = g.select(*keys, F.explode(F.array(*map(of, columns))).alias("_c"))
    out = parts.select(*keys, F.col("_c.name").alias(name), F.explode("_c.qs").alias("_q"))
    return out.select(*keys, name, F.col("_q.p").alias("Quantile"), F.col("_q.q").alias(value))


def rate_quantiles(rates: DataFrame, axis: str = "Cohort", probs: list[float] | None = None) -> DataFrame:
    """J12 (H8 + D14): exact type-7 quantiles of every component over the draws, by
    (Country, Age, axis, Component) (not ``percentile_approx``: parity)."""
    probs = probs or [i / 100 for i in range(1, 100)]
    labels = {c: COMPONENT_LABELS.get(c, c) for c in ("Comp_1", "Comp_2", "Rate")}
    return exact_quantiles(rates, ["Country", "Age", axis], labels, probs, "Component", "Rate")


FAN_PROBS = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


def parameter_fans(draws: DataFrame, cfg: CohortConfig, axis: str = "Cohort",
                   probs: tuple[float, ...] = FAN_PROBS) -> DataFrame:
    """Fan-chart tables (quantiles over draws by time) for the level, the two
    locations, the two spreads and the mixture weight."""
    p = draws.select(
        "Country", "Sim", axis,
        F.col("CEB").alias("CFS"),
        (F.lit(0.5) * (F.col("mode_age_sum") - F.col("mode_age_gap"))).alias("Mode_1"),
        (F.lit(0.5) * (F.col("mode_age_sum") + F.col("mode_age_gap"))).alias("Mode_2"),
        F.col("sd_1").alias("Sd_1"),
        F.col("sd_2").alias("Sd_2"),
        inv_logit(F.col("logit_mixture")).alias("Mixture"),
    )
    names = ["CFS", "Mode_1", "Mode_2", "Sd_1", "Sd_2", "Mixture"]
    return exact_quantiles(p, ["Country", axis], {c: c for c in names}, list(probs), "param", "value")
