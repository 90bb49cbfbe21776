"""Registered queries: file sources and sinks (A1-A15), random-walk extension."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..config import FIXTURE as C
from ..operators import comparators as cmp
from ..operators import likelihood as lk
from ..operators import prep
from ..operators import rates as rt
from ..sources import files as fl
from ..sources import fixtures as fx
from ..sources.tables import read_table
from . import q_comparators as qc
from . import q_scoring as qs
from .q_prep import _RUNSPEC_SQL
from .registry import register
from .views_sql import with_views


@register("landed_rates", "A1 A2 A3 A4 A5 A7 A15 C1 B9", with_views("select * from rates", ["rates"]),
          ["Exposure", "Births", "Rate"])
def q_landed_rates(spark, sf_dir):
    base = fl.shared_dir(spark, "extracts")
    fl.write_extracts(fx.births_table(spark, sf_dir), fx.exposure_table(spark, sf_dir), base, fl.LEXIS["Cohort"])
    births = fl.read_item(spark, base, "births", fl.LEXIS["Cohort"])
    expos = fl.read_item(spark, base, "expos", fl.LEXIS["Cohort"])
    cols = ["Country", "Year", "Age", "Cohort"]
    return rt.empirical_rates(expos.select(*cols, "Exposure"), births.select(*cols, "Births"), cols)


_RUNSPEC_CSV_SQL = """
select param_type_1, param_type_2, model_name, country, dispersion, base_config,
       cast(row_number() over (order by country, param_type_1, param_type_2, model_name, dispersion) as int) as run_id
from (""" + _RUNSPEC_SQL + ") g"


@register("run_spec_csv", "A8 A9 C13 I23", _RUNSPEC_CSV_SQL)
def q_run_spec_csv(spark, sf_dir):
    path = fl.shared_dir(spark, "run_specs")
    fl.write_run_specs(prep.run_spec_grid(fx.countries(spark, sf_dir), C), path)
    return fl.read_run_specs(spark, path)


def elapsed(sampler):
    """Seconds of a chain's warm-up and sampling, from its iterations' energy and tree depth."""
    return sampler.groupBy("Country", "Chain").agg(F.round(F.sum("energy__") / F.lit(100.0), 3).alias("warmup"),
                                                   F.round(F.sum("treedepth__") / F.lit(8.0), 3).alias("sampling"))


ELAPSED_SQL = """
select Country, Chain, round(sum(energy__)/100.0e0, 3) as warmup, round(sum(treedepth__)/8.0e0, 3) as sampling
from sampler_params group by Country, Chain"""


def sampler_files(spark, sf_dir):
    """The run's sampler files, written for the caller."""
    base = fl.shared_dir(spark, "sampler_csv")
    sp = fx.sampler_params(spark, sf_dir, C)
    return fl.write_sampler_csv(sp, _stepsizes(sp), base, elapsed(sp))


def _stepsizes(sampler):
    return sampler.groupBy("Country", "Chain").agg(F.round(F.avg("energy__") / F.lit(1000.0), 6).alias("stepsize"))


_SAMPLER_SQL = f"""
select Country, Chain, cast(count(*) as int) as n_iter, cast(sum(divergent__) as bigint) as n_div,
       count(*) filter (where treedepth__ = {C.max_treedepth}) as n_max_treedepth,
       round(avg(energy__)/1000.0e0, 6) as stepsize, round(sum(energy__)/100.0e0, 3) as warmup, round(sum(treedepth__)/8.0e0, 3) as sampling
from sampler_params group by Country, Chain"""


@register("sampler_csv", "A14 E6 L8 L9 D17 D18", with_views(_SAMPLER_SQL, ["sampler_params"]), ["stepsize", "warmup", "sampling"])
def q_sampler_csv(spark, sf_dir):
    base = sampler_files(spark, sf_dir)
    rows = fl.read_sampler_csv(spark, base)
    per = rows.groupBy("Country", "Chain").agg(
        F.max("iter").alias("n_iter"), F.sum("divergent__").cast("long").alias("n_div"),
        F.count(F.when(F.col("treedepth__") == C.max_treedepth, 1)).alias("n_max_treedepth"),
    )
    return per.join(fl.read_stepsizes(spark, base), ["Country", "Chain"]).join(fl.read_elapsed(spark, base), ["Country", "Chain"])


_LATEST_SQL = with_views("", ["rates"]) + qc._FREEZE_CTE + f"""
select strftime(max(o_orderdate), '%Y%m%d_%H%M%S') as run, f.Country, f.RMSE_rate, f.n_cells
from (select Country, sqrt({qc._rmean('SE_rate')}) as RMSE_rate, count(*) as n_cells from frz group by Country) f,
     orders
group by f.Country, f.RMSE_rate, f.n_cells"""


@register("latest_run", "A11 A12 A15 G2 F2 I20", _LATEST_SQL, ["RMSE_rate"])
def q_latest_run(spark, sf_dir):
    base = fl.shared_dir(spark, "runs")
    summ = cmp.freeze_summary(qc.freeze(spark, sf_dir)).select("Country", "RMSE_rate")
    counts = qc.freeze(spark, sf_dir).groupBy("Country").agg(F.count(F.lit(1)).alias("n_cells"))
    stamps = read_table(spark, sf_dir, "orders").agg(
        F.date_format(F.min("o_orderdate"), "yyyyMMdd_HHmmss").alias("first"),
        F.date_format(F.max("o_orderdate"), "yyyyMMdd_HHmmss").alias("last"),
    )
    # an older run without the n_cells column and the latest run with it (schemas merged on read)
    first, last = cmp.scalar(stamps, "first"), cmp.scalar(stamps, "last")
    old = summ.withColumn("run", F.lit(first))
    new = summ.join(counts, "Country").withColumn("run", F.lit(last))
    fl.write_table(old, base, ["run"])
    new.write.mode("append").partitionBy("run").parquet(base)
    return fl.latest_run(spark, base).select("run", "Country", "RMSE_rate", "n_cells")


def _extension_sql() -> str:
    last = C.start_time + C.T_total - 1
    steps = ", ".join(f"{p} + {lk.RW_SCALE}e0*list_sum(list_transform(range(1, h + 1), lambda j: "
                      f"{qs.hash_normal_sql(C.seed, 'Country', 'Sim', repr(str(pid)), 'j')})) as {p}" for pid, p in enumerate(lk.INITIAL_PRIORS))
    inside = " and ".join(f"{p} > {lo}e0" for p, lo in lk.RW_LOWER.items())
    return with_views(f"""
select * from (select Country, Sim, cast({last} + h as bigint) as Cohort, {steps}
               from draws, (select unnest(range(1, {C.T_forecast + 1})) as h) s where Cohort = {last}) x
qualify bool_and({inside}) over (partition by Country, Sim)""", ["draws"])


@register("rw_extension", "J17 E5", _extension_sql(), list(lk.INITIAL_PRIORS))
def q_rw_extension(spark, sf_dir):
    return lk.rw_extension(fx.draws(spark, sf_dir, C), C)


_VINTAGE_SQL = """
select r_name as Country, strftime(max(cast(o_orderdate as date)), '%Y-%m-%d') as HFD_date
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
     join region on n_regionkey = r_regionkey
group by r_name"""


@register("data_vintage", "A6", _VINTAGE_SQL)
def q_data_vintage(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    geo = fx.geography(spark, sf_dir)
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(geo), F.col("c_nationkey") == geo.n_nationkey)
    # ISO text at the query edge (the operator returns a DATE)
    return fl.data_vintage(j, "o_orderdate").withColumn("HFD_date", F.date_format("HFD_date", "yyyy-MM-dd"))
