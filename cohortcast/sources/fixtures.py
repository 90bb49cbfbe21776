"""Derived views over the driver's test tables (the fixture of FIXTURES.md part 2).

* ``cells``     births and exposure by (Country, Year, Age, Cohort), aggregated
                from lineitem x orders x customer x nation x region.  This is the
                scan-heavy view: it grows with the data.
* ``draws``     stored wide posterior draws by (Country, Sim, Cohort), for all
                countries and the configured cohorts.
* ``dispersion``dispersion draws by (Country, Sim, Age).
* ``sampler_params`` per-iteration sampler diagnostics.
* ``posterior_quantiles`` comparator posterior derived from ``cells``.

The draw-level tables are made once (``explode(sequence(..))``, no cross join, values
moved by an aggregate of lineitem), stored by Country, and hash-partitioned by (Country,
Sim) where they are read, so all per-draw work downstream (per-draw sums, tail-bin
aggregation, per-draw sampling) reuses that partitioning instead of shuffling the
exploded rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FIXTURE, CohortConfig
from .tables import read_table


#: What the random walks of a model run over.
SIGMA_OF = ("CEB", "mode_age_sum", "mode_age_gap", "sd_1", "sd_2", "logit_mixture", "disp")


def _u(j: int, at: Column) -> Column:
    """Number in [0, 1) for value ``j`` at time or age ``at`` of a draw: equally spread over a chain's iterations, and
    moved a little by the draw's ``mass`` in lineitem."""
    h = (F.col("Chain") * F.lit(7919) + at * F.lit(104729) + F.col("rk") * F.lit(15485863) + F.lit(j * 1299709)
         + F.col("Iter") * F.lit(6185) + F.col("mass") % F.lit(97)) % F.lit(10007)
    return h / F.lit(10007.0)


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> region name; TPC-H fixes these at 25 and 5 rows, so broadcasting is bounded."""
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", F.col("r_name").alias("Country")
    )


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The countries of the runs, without a look at the facts."""
    return read_table(spark, sf_dir, "region").select(F.col("r_name").alias("Country"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the year and country of its order."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    geo = geography(spark, sf_dir)
    order_geo = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(F.broadcast(geo), F.col("c_nationkey") == geo.n_nationkey)
        .select("o_orderkey", F.year("o_orderdate").cast("int").alias("Year"), F.month("o_orderdate").alias("Month"), "Country")
    )
    return li.join(order_geo, li.l_orderkey == order_geo.o_orderkey)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Births (line count) and exposure (price mass) by Country, Year, Age, Cohort."""
    age = F.col("l_quantity").cast("int") + F.lit(5)
    return _as_cells(
        _lines(spark, sf_dir).groupBy("Country", "Year", age.alias("Age"))
        .agg(F.count(F.lit(1)).alias("lines"), F.sum(F.round(F.col("l_extendedprice") * F.lit(100)).cast("bigint")).alias("cents"))
    )


def _as_cells(sums: DataFrame) -> DataFrame:
    """``cells`` from the lines and the price in cents of each Country, Year and Age."""
    return sums.select("Country", "Year", "Age", (F.col("Year") - F.col("Age")).alias("Cohort"), F.col("lines").cast("double").alias("Births"),
                       (F.col("cents").cast("double") / F.lit(500000.0)).alias("Exposure"))


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cells`` split into Lexis triangles: (Country, Year, Age reached in the year, Cohort, ``after`` the birthday, Births,
    Exposure).  A line is after its mother's birthday if its order is of the second half of the year."""
    age = F.col("l_quantity").cast("int") + F.lit(5)
    return (
        _lines(spark, sf_dir).groupBy("Country", "Year", age.alias("Age"), (F.col("Month") > 6).alias("after"))
        .agg(F.count(F.lit(1)).cast("double").alias("Births"),
             (F.sum(F.round(F.col("l_extendedprice") * F.lit(100)).cast("bigint")).cast("double") / F.lit(500000.0)).alias("Exposure"))
        .select("Country", "Year", "Age", (F.col("Year") - F.col("Age")).alias("Cohort"), "after", "Births", "Exposure")
    )


_CELLS_MEMO: dict[tuple[str, str], DataFrame] = {}


def cells_checkpointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cells`` materialised once per application into the shared checkpoint directory.

    Used as the small side of draw-level joins: the scan-and-aggregate of the fact
    tables runs once, its lineage is cut (a lost executor re-reads the checkpoint,
    not lineitem), and the row count that guards the broadcast is cheap."""
    from ..session import app_id, ensure_checkpoint_dir

    key = (app_id(spark), sf_dir)
    if key not in _CELLS_MEMO:
        ensure_checkpoint_dir(spark)
        _CELLS_MEMO[key] = cells(spark, sf_dir).checkpoint(eager=True)
    return _CELLS_MEMO[key]


def draw_partitions(spark: SparkSession) -> int:
    """Partitions of the draw-level tables: the session's shuffle partition count."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def draw_mass(spark: SparkSession, sf_dir: str, cfg: CohortConfig) -> DataFrame:
    """Lines and quantity of the orders that fall to each draw (l_orderkey modulo the number of draws), by Country: one
    row per draw, whatever the size of lineitem.

    Made once per application, data and number of draws, as all draw-level tables take it; the same pass over the fact
    tables makes ``cells_checkpointed``, which the likelihood of those draws takes, unless it is there already."""
    from ..operators.small import small_table
    from ..session import app_id, ensure_checkpoint_dir

    def build():
        key = (app_id(spark), sf_dir)
        if key in _CELLS_MEMO:
            return _as_mass(_lines(spark, sf_dir).groupBy("Country", _sim(cfg).alias("Sim")).agg(
                F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("int")).alias("quantity")))
        ensure_checkpoint_dir(spark)
        of_cells, of_draws = _cell_and_draw_sums(spark, sf_dir, cfg)
        _CELLS_MEMO[key] = _as_cells(of_cells)
        return _as_mass(of_draws)

    return small_table(spark, ("draw_mass", sf_dir, cfg.n_draws), build, broadcast=False)


def _sim(cfg: CohortConfig) -> Column:
    return (F.col("l_orderkey") % F.lit(cfg.n_draws)).cast("bigint")


def _as_mass(sums: DataFrame) -> DataFrame:
    return sums.select("Country", "Sim", (F.col("lines") + F.col("quantity")).alias("mass"))


def _cell_and_draw_sums(spark: SparkSession, sf_dir: str, cfg: CohortConfig) -> tuple[DataFrame, DataFrame]:
    """Sums of the lines by (Country, Year, Age) and by (Country, Sim): two grouping sets of one pass, stored."""
    quantity = F.col("l_quantity").cast("int")
    lines = _lines(spark, sf_dir).select("Country", "Year", (quantity + F.lit(5)).alias("Age"), _sim(cfg).alias("Sim"), quantity.alias("quantity"),
                                         F.round(F.col("l_extendedprice") * F.lit(100)).cast("bigint").alias("cents"))
    sets = lines.groupingSets([["Country", "Year", "Age"], ["Country", "Sim"]], "Country", "Year", "Age", "Sim").agg(
        F.grouping("Sim").alias("of_cell"), F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("quantity"), F.sum("cents").alias("cents"))
    sets = sets.checkpoint(eager=True)
    return sets.filter("of_cell = 1"), sets.filter("of_cell = 0")


def _draw_keys(spark: SparkSession, sf_dir: str, cfg: CohortConfig) -> DataFrame:
    """(Country, rk, Sim, Chain, Iter, mass) for every draw of every country, whether it has cells or not."""
    per_chain = cfg.iters_per_chain
    region = read_table(spark, sf_dir, "region").select(F.col("r_name").alias("Country"), F.col("r_regionkey").alias("rk"))
    keys = region.select("Country", "rk",
                         F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cfg.n_draws - 1).cast("bigint"))).alias("Sim"))
    keys = keys.join(draw_mass(spark, sf_dir, cfg), ["Country", "Sim"], "left")
    return keys.select(
        "Country", "rk", "Sim",
        (F.lit(1) + F.floor(F.col("Sim") / F.lit(per_chain)).cast("int")).alias("Chain"),
        (F.lit(1) + F.col("Sim") % F.lit(per_chain)).alias("Iter"),
        F.coalesce("mass", F.lit(0)).alias("mass"),
    )


def _stored(spark: SparkSession, sf_dir: str, cfg: CohortConfig, name: str, build) -> DataFrame:
    """A table of the run, written once per application, data and configuration, by Country, and read back; partitioned
    by draw, so that the work of a draw stays in one task.

    The explicit number of partitions keeps AQE from running the whole draw x age expansion in one task."""
    from ..operators.small import stored_table

    table = stored_table(spark, (name, sf_dir, cfg), build, "Country")
    return table.repartition(draw_partitions(spark), "Country", "Sim")


def _cohorts(cfg: CohortConfig) -> Column:
    first = cfg.first_full_cohort
    return F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(first + cfg.T_total - 1).cast("bigint")))


def draws(spark: SparkSession, sf_dir: str, cfg: CohortConfig = FIXTURE) -> DataFrame:
    """Stored wide posterior draws: one row per (Country, Sim, Cohort) for the configured cohorts.

    The countries (by region key) stand for runs that converge (0), have one chain apart (1), two modes (2), diverge (3),
    and never converge (4)."""

    def build():
        d = _draw_keys(spark, sf_dir, cfg).select("*", _cohorts(cfg).alias("Cohort"))
        c, rk, chain = F.col("Cohort"), F.col("rk"), F.col("Chain")
        apart = F.when((rk == 1) & (chain == 4), 0.5).when((rk == 2) & (chain >= 3), 0.5).when(rk == 4, chain * 0.25).otherwise(0.0)
        return d.select(
            "Country", "Sim", "Chain", "Iter", "Cohort",
            (F.lit(1.5) + _u(1, c) + apart).alias("CEB"),
            (F.lit(5.0) + F.lit(3.0) * _u(2, c)).alias("mode_age_gap"),
            (F.lit(52.0) + F.lit(6.0) * _u(3, c)).alias("mode_age_sum"),
            (F.lit(4.0) + F.lit(2.0) * _u(4, c)).alias("sd_1"),
            (F.lit(4.0) + F.lit(2.0) * _u(5, c)).alias("sd_2"),
            (F.lit(2.0) * _u(6, c) - F.lit(1.0)).alias("logit_mixture"),
        )

    return _stored(spark, sf_dir, cfg, "draws", build)


def dispersion(spark: SparkSession, sf_dir: str, cfg: CohortConfig = FIXTURE) -> DataFrame:
    """Stored dispersion draws: one row per (Country, Sim, Age) for the configured ages."""

    def build():
        ages = F.explode(F.sequence(F.lit(cfg.first_data_age).cast("bigint"), F.lit(cfg.last_data_age).cast("bigint")))
        d = _draw_keys(spark, sf_dir, cfg).select("*", ages.alias("Age"))
        return d.select("Country", "Sim", "Age", (F.lit(2.0) + F.lit(20.0) * _u(7, F.col("Age"))).alias("Dispersion"))

    return _stored(spark, sf_dir, cfg, "dispersion", build)


def dispersion_constant(spark: SparkSession, sf_dir: str, cfg: CohortConfig = FIXTURE) -> DataFrame:
    """Draws of the constant variant's one dispersion, by parameter name: (Country, Sim, param, value)."""
    d = dispersion(spark, sf_dir, cfg).filter(F.col("Age") == cfg.first_data_age)
    return d.select("Country", "Sim", F.lit("dispersion").alias("param"), (F.col("Dispersion") + F.lit(1.0)).alias("value"))


def dispersion_coefficients(spark: SparkSession, sf_dir: str, cfg: CohortConfig = FIXTURE) -> DataFrame:
    """Draws of the spline coefficients of the log dispersion: (Country, Sim, k, beta)."""
    d = dispersion(spark, sf_dir, cfg)
    k = (F.col("Age") - cfg.first_data_age + 1).cast("int")
    return d.filter(k <= cfg.n_dispersion_basis).select("Country", "Sim", k.alias("k"), (F.col("Dispersion") / F.lit(22.0)).alias("beta"))


def log_dispersion(spark: SparkSession, sf_dir: str, cfg: CohortConfig = FIXTURE) -> DataFrame:
    """Draws of the log dispersion of each age's number: (Country, Sim, k, beta)."""
    k = (F.col("Age") - cfg.first_data_age + 1).cast("int")
    return dispersion(spark, sf_dir, cfg).select("Country", "Sim", k.alias("k"), (F.col("Dispersion") / F.lit(22.0)).alias("beta"))


def sigmas(spark: SparkSession, sf_dir: str, cfg: CohortConfig = FIXTURE) -> DataFrame:
    """Draws of the random walks' sigmas: one row per (Country, Sim), a column per parameter and one for the dispersion."""

    def build():
        return _draw_keys(spark, sf_dir, cfg).select("Country", "Sim", *[
            (F.lit(0.5) + F.lit(2.0) * _u(11 + j, F.lit(1))).alias(f"sigma_{p}") for j, p in enumerate(SIGMA_OF)])

    return _stored(spark, sf_dir, cfg, "sigmas", build)


def sampler_params(spark: SparkSession, sf_dir: str, cfg: CohortConfig = FIXTURE) -> DataFrame:
    """Stored sampler diagnostics of each iteration (divergences, tree depth, energy)."""

    def build():
        one = F.lit(1)
        return _draw_keys(spark, sf_dir, cfg).select(
            "Country", "Sim", "Chain", "Iter",
            F.when((F.col("rk") == 3) & (_u(8, one) < F.lit(0.05)), 1).otherwise(0).alias("divergent__"),
            (F.lit(6) + F.floor(F.lit(7.0) * _u(9, one)).cast("int")).alias("treedepth__"),
            (F.lit(50.0) + F.lit(10.0) * _u(10, one)).alias("energy__"),
        )

    return _stored(spark, sf_dir, cfg, "sampler_params", build).drop("Sim")


def posterior_quantiles(spark: SparkSession, sf_dir: str, cfg: CohortConfig = FIXTURE) -> DataFrame:
    """Comparator posterior (prediction and 5/25/75/95 percentiles) for every cell."""
    c = cells(spark, sf_dir)
    asfr = F.col("Births") / F.col("Exposure")
    factor = F.lit(0.9) + F.lit(0.2) * ((F.col("Age") * F.lit(31) + F.col("Cohort") * F.lit(17)) % F.lit(11)) / F.lit(10.0)
    pred = asfr * factor
    return c.select(
        "Country",
        "Cohort",
        F.col("Age").alias("ARDY"),
        "Year",
        asfr.alias("ASFR"),
        pred.alias("ASFR_prediction"),
        (pred * F.lit(0.92)).alias("p5"),
        (pred * F.lit(0.97)).alias("p25"),
        (pred * F.lit(1.03)).alias("p75"),
        (pred * F.lit(1.08)).alias("p95"),
        (F.col("Year") <= F.lit(cfg.jump_off)).alias("V_ind"),
    )


def births_table(spark: SparkSession, sf_dir: str, materialized: bool = False) -> DataFrame:
    """Births extract (T1 shape) taken from ``cells``."""
    c = cells_checkpointed(spark, sf_dir) if materialized else cells(spark, sf_dir)
    return c.select("Country", "Year", "Age", "Cohort", "Births")


def exposure_table(spark: SparkSession, sf_dir: str, materialized: bool = False) -> DataFrame:
    """Exposure extract (T2 shape) taken from ``cells``."""
    c = cells_checkpointed(spark, sf_dir) if materialized else cells(spark, sf_dir)
    return c.select("Country", "Year", "Age", "Cohort", "Exposure")


def register_views(spark: SparkSession, sf_dir: str, cfg: CohortConfig = FIXTURE) -> list[str]:
    """Expose the fixture views to Spark SQL (``spark.sql("select ... from draws")``)."""
    views = {
        "cells": cells(spark, sf_dir),
        "draws": draws(spark, sf_dir, cfg),
        "dispersion": dispersion(spark, sf_dir, cfg),
        "sampler_params": sampler_params(spark, sf_dir, cfg),
        "posterior_quantiles": posterior_quantiles(spark, sf_dir, cfg),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
