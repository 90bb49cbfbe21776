"""The fact tables are read once for a run's cells and draws, and densities are evaluated only where an observation needs them."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cohortcast.config import FIXTURE as C
from cohortcast.functions.numeric import lgamma, with_lgamma
from cohortcast.operators import likelihood as lk
from cohortcast.operators.draws import rate_draws
from cohortcast.plans import q_prep
from cohortcast.plans.q_reports import PAIRS
from cohortcast.sources import fixtures as fx

from .conftest import SF_SMALL


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain_mass(spark, sf_dir, n_draws):
    return fx._lines(spark, sf_dir).groupBy("Country", (F.col("l_orderkey") % n_draws).alias("Sim")).agg(
        (F.count(F.lit(1)) + F.sum(F.col("l_quantity").cast("int"))).alias("mass"))


@pytest.fixture
def odd_tables(spark, tmp_path):
    """Two countries; an order without a date, lines without a quantity or a price, an order without a customer."""
    def put(name, data, schema):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))

    put("region", [(0, "AFRICA"), (1, "ASIA")], "r_regionkey int, r_name string")
    put("nation", [(0, 0), (1, 1), (2, 1)], "n_nationkey int, n_regionkey int")
    put("customer", [(1, 0), (2, 1), (3, 2)], "c_custkey long, c_nationkey int")
    put("orders", [(1, 1, datetime(1996, 1, 1)), (2, 2, datetime(1996, 7, 1)), (3, 3, None), (4, 9, datetime(1997, 1, 1)), (5, 3, datetime(1996, 2, 2))],
        "o_orderkey long, o_custkey long, o_orderdate timestamp")
    put("lineitem", [(1, 3.0, 10.01), (1, None, 5.0), (2, 3.0, None), (3, 4.0, 7.5), (4, 1.0, 1.0), (5, 3.0, 2.25), (5, None, 1.5)],
        "l_orderkey long, l_quantity double, l_extendedprice double")
    return str(tmp_path)


def test_fact_tables_are_read_once(spark, tmp_path, monkeypatch):
    sf = f"{tmp_path}/again"  # a path that no other test has read
    os.symlink(SF_SMALL, sf)
    reads = []
    plain = fx._lines
    monkeypatch.setattr(fx, "_lines", lambda *a: reads.append(a) or plain(*a))
    for table in (fx.draws, fx.dispersion, fx.sampler_params, fx.sigmas):
        table(spark, sf, C).count()
    fx.cells_checkpointed(spark, sf).count()
    assert len(reads) == 1
    monkeypatch.undo()
    assert rows(fx.cells_checkpointed(spark, sf)) == rows(fx.cells(spark, sf))
    assert rows(fx.draw_mass(spark, sf, C)) == rows(plain_mass(spark, sf, C.n_draws))


@pytest.mark.parametrize("cells_first", [False, True])
def test_one_pass_keeps_nulls_apart(spark, odd_tables, cells_first):
    few = C.with_(n_draws=4)
    if cells_first:
        fx.cells_checkpointed(spark, odd_tables)
    mass = rows(fx.draw_mass(spark, odd_tables, few))
    assert mass == rows(plain_mass(spark, odd_tables, 4)) and len(mass) == 4
    cells = rows(fx.cells_checkpointed(spark, odd_tables))
    assert cells == rows(fx.cells(spark, odd_tables)) and len(cells) == 5
    assert ("ASIA", None, 9, None, 1.0, 0.0015) in cells


def few_draws(spark):
    return fx.draws(spark, SF_SMALL, C).filter(F.col("Sim") % 50 == 0)


def test_rates_only_at_the_cells_of_observations(spark):
    grid, obs = q_prep.small_grid(spark, SF_SMALL), q_prep.small_obs(spark, SF_SMALL)
    seen = q_prep.small_observed(spark, SF_SMALL)
    bins = {(r.Country, r.Cohort, r.Age) for r in obs.collect()}
    clamp = lambda a: max(min(a, C.last_data_age), C.first_data_age)
    want = {(r.Country, r.Cohort, r.Age, r.Exposure) for r in grid.collect() if (r.Country, r.Cohort, clamp(r.Age)) in bins}
    assert {(r.Country, r.Cohort, r.Age, r.Exposure) for r in seen.collect()} == want and 0 < len(want) < grid.count()
    d = few_draws(spark)
    n_draws = d.select("Country", "Sim").distinct().groupBy("Country").count().first()["count"]
    assert rate_draws(d, C, cells=seen.select("Country", "Cohort", "Age", "Exposure")).count() == n_draws * len(want)
    both = [{tuple(r)[:-1]: r.ll for r in lk.loglik(d, g, obs, fx.dispersion(spark, SF_SMALL, C), C).collect()} for g in (grid, seen)]
    assert both[0].keys() == both[1].keys() and all(abs(v - both[1][k]) <= 1e-11 * max(1.0, abs(v)) for k, v in both[0].items())


def test_pairs_of_densities_share_their_evaluations(spark):
    seen, obs = q_prep.small_observed(spark, SF_SMALL), q_prep.small_obs(spark, SF_SMALL)
    disp, d = fx.dispersion(spark, SF_SMALL, C), few_draws(spark)
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("p1"), F.lit(b).alias("p2")) for a, b in PAIRS]))
    named = d.select("*", pairs.alias("m")).select("*", "m.*").drop("m")
    by_row = lk.loglik(named, seen, obs, disp, C, model_keys=("p1", "p2"))
    shared = lk.loglik(d, seen, obs, disp, C, pairs=PAIRS)
    assert shared.columns == by_row.columns
    a, b = ({tuple(r)[:-1]: r.ll for r in df.collect()} for df in (by_row, shared))
    assert a.keys() == b.keys() and len({k[1:3] for k in a}) == len(PAIRS)
    assert all(abs(v - b[k]) <= 1e-11 * max(1.0, abs(v)) for k, v in a.items())
    few = rate_draws(d, C, pairs=[("gamma_density", "hadwiger_density")]).select("p1", "p2").distinct().collect()
    assert [tuple(r) for r in few] == [("gamma_density", "hadwiger_density")]


def test_staged_log_gamma_is_the_plain_one(spark):
    x = [None, -1.0, 0.0, 1e-9, 0.5, 1.0, 2.0, 7.25, 1e4, 9999999.0, 1e7, 3e12, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    out = with_lgamma(df, {"a": F.col("v"), "b": F.col("v") + 1.0}).select("*", lgamma(F.col("v")).alias("pa"), lgamma(F.col("v") + 1.0).alias("pb"))
    assert [(repr(r.a), repr(r.b)) for r in out.collect()] == [(repr(r.pa), repr(r.pb)) for r in out.collect()]
