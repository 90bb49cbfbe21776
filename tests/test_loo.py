import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortcast.config import FIXTURE
from cohortcast.operators import folds, loo, psis
from cohortcast.operators import likelihood as lk
from cohortcast.plans.registry import all_queries

from .conftest import SF_SMALL


def test_psis_recovers_pareto_tail_shape():
    rng = np.random.default_rng(7)
    k_true = 0.5
    s = 4000
    # importance ratios with a generalised Pareto tail of shape k: log ratio = -ll
    u = rng.uniform(size=s)
    ratios = ((1 - u) ** (-k_true) - 1) / k_true
    ll = -np.log(ratios + 1e-12)
    [k] = psis.psis_rows(ll[None], np.ones(1))[1]
    assert k == pytest.approx(k_true, abs=0.15)


def test_psis_well_behaved_small_k():
    rng = np.random.default_rng(8)
    ll = rng.normal(-3.0, 0.1, size=2000)
    [elpd], [k] = psis.psis_rows(ll[None], np.ones(1))
    assert k < 0.5
    direct = -math.log(np.mean(np.exp(-ll)))
    assert elpd == pytest.approx(direct, abs=1e-3)


def test_is_loo_equals_direct(spark):
    rng = np.random.default_rng(9)
    vals = rng.normal(-2.0, 0.7, size=300)
    df = spark.createDataFrame([("A", 1, i, float(v)) for i, v in enumerate(vals)], "Country string, i int, Sim long, ll double")
    r = loo.is_loo(df).collect()[0]
    assert r["lpd"] == pytest.approx(math.log(np.mean(np.exp(vals))), rel=1e-12)
    assert r["elpd_is"] == pytest.approx(-math.log(np.mean(np.exp(-vals))), rel=1e-12)


def _points(spark, pts):
    return spark.createDataFrame([("A", i + 1, t, a) for i, (t, a) in enumerate(pts)],
                                 "Country string, i int, Time int, Age_i int")


def test_folds_small_sets(spark):
    got = folds.best_folds(_points(spark, [(1, 1), (5, 5), (9, 9)])).orderBy("i").collect()
    assert [r["fold"] for r in got] == [1, 2, 3] and {r.min_within_dist for r in got} == {None} and not any(r.too_near for r in got)
    assert folds.best_folds(_points(spark, [(1, 1)]).limit(0)).count() == 0


def by_hand(pts, n_splits):
    """Folds and least distance of the first of the best splits."""
    best = None
    for split in range(n_splits):
        own = (split * 69621 + 48271) * 40014 % folds.PRIME
        order = sorted(range(1, len(pts) + 1), key=lambda i: ((i * own % folds.PRIME) * (i + split) % folds.PRIME if split else 0, i))
        fold = {i: k % 3 + 1 for k, i in enumerate(order)}
        least = min(math.dist(pts[i - 1], pts[j - 1]) for i in fold for j in fold if i < j and fold[i] == fold[j])
        if best is None or least > best[1]:
            best = fold, least
    return best


def test_folds_equal_a_search_by_hand(spark):
    rng = np.random.default_rng(10)
    dense = [(int(t), int(a)) for t in range(1, 6) for a in range(1, 5)]
    wide = [(int(t), int(a)) for t, a in rng.integers(1, 2000, size=(7, 2))]  # nothing within the first rings
    some = list({(int(t), int(a)) for t, a in rng.integers(1, 40, size=(11, 2))})
    for pts in (dense, wide, some):
        got = {r.i: r for r in folds.best_folds(_points(spark, pts), n_splits=20).collect()}
        fold, least = by_hand(pts, 20)
        assert {i: r.fold for i, r in got.items()} == fold
        assert all(r.min_within_dist == pytest.approx(least) and r.too_near == (least < 2) for r in got.values())
        near = {r.i: r.nn_dist for r in folds.nearest(_points(spark, pts)).collect()}
        for i, p in enumerate(pts, 1):
            assert near[i] == pytest.approx(min(math.dist(p, q) for q in pts if q != p))
    assert [r.nn_dist for r in folds.nearest(_points(spark, [(4, 4)])).collect()] == [None]


def test_kept_sums_of_all_folds_in_one_scan(spark):
    ll = spark.createDataFrame([("A", i, s, float(i * 10 + s)) for i in range(1, 6) for s in (0, 1)], "Country string, i int, Sim long, ll double")
    runs = spark.createDataFrame([("A", 1, 1), ("A", 1, 4), ("A", 3, 4)], "Country string, fold int, i int")
    got = {(r.fold, r.Sim): (r.ll_keep, r.n_keep) for r in lk.loglik_keep(ll, runs).collect()}
    assert got == {(1, 0): (100.0, 3), (1, 1): (103.0, 3), (3, 0): (110.0, 4), (3, 1): (114.0, 4)}


def one_point(ll, r_eff):
    """PSIS of one series, draw by draw."""
    s, lw = len(ll), -ll - max(-ll)
    t = math.ceil(min(0.2 * s, 3 * math.sqrt(s / r_eff)))
    order = np.argsort(lw)
    cut = math.exp(lw[order[s - t - 1]])
    x = [math.exp(lw[k]) - cut for k in order[s - t:]]
    m = 30 + int(math.sqrt(t))
    theta = [1 / x[-1] + (1 - math.sqrt(m / (j - 0.5))) / (3 * x[int(t / 4 + 0.5) - 1]) for j in range(1, m + 1)]
    shape = [sum(math.log1p(-th * v) for v in x) / t for th in theta]
    fit = [t * (math.log(-th / k) - k - 1) for th, k in zip(theta, shape)]
    th = sum(a / sum(math.exp(g - f) for g in fit) for a, f in zip(theta, fit))
    k = sum(math.log1p(-th * v) for v in x) / t
    sigma, k = -k / th, (k * t + 5) / (t + 10)
    lw = lw.copy()
    for j, at in enumerate(order[s - t:], 1):
        lw[at] = min(0.0, math.log(sigma * ((1 - (j - 0.5) / t) ** -k - 1) / k + cut))
    return math.log(sum(np.exp(lw + ll)) / sum(np.exp(lw))), k


def test_rows_of_a_matrix_equal_single_points():
    rng = np.random.default_rng(3)
    ll = -rng.gamma(2.0, rng.uniform(0.2, 3.0, size=(40, 1)), size=(40, 160))
    r_eff = rng.uniform(0.2, 2.5, size=40)
    elpd, k = psis.psis_rows(ll, r_eff)
    for n in range(40):
        assert (elpd[n], k[n]) == (pytest.approx(one_point(ll[n], r_eff[n])[0]), pytest.approx(one_point(ll[n], r_eff[n])[1]))
    elpd, k = psis.psis_rows(np.full((2, 100), -3.0), np.ones(2))
    assert np.allclose(elpd, -3.0) and np.isinf(k).all()


def test_draws_of_uneven_chains(spark):
    """Series of different lengths and chains in one table, small matrices; a chain's surplus draws don't count for the ESS."""
    rng = np.random.default_rng(6)
    rows = [(p, c, t, float(rng.normal())) for p, sizes in (("a", (30, 30)), ("b", (30, 25)), ("c", (40, 40)), ("d", (3, 3))) for c, n in enumerate(sizes, 1) for t in range(n)]
    df = spark.createDataFrame(rows, "param string, Chain int, Iter int, value double").withColumn("Country", F.lit("A"))
    from cohortcast.operators.diagnostics import effective_sample_size

    got = {r.param: r for r in effective_sample_size(df.repartition(3)).collect()}
    assert {p: r.n_draws for p, r in got.items()} == {"a": 60, "b": 55, "c": 80, "d": 6}
    for p, n in (("a", 30), ("b", 25), ("c", 40)):
        x = np.array([[v for q, c, t, v in rows if (q, c) == (p, k) and t < n] for k in (1, 2)])
        assert got[p].ess == pytest.approx(psis.ess_rows(x[None])[0])
    assert math.isnan(got["d"].ess)


def test_lko_runs_numeric_order(spark):
    folds = spark.createDataFrame([("A", 20, 1, 0.0), ("A", 3, 1, 0.0), ("A", 17, 1, 0.0)],
                                  "Country string, i int, fold int, min_within_dist double")
    assert loo.lko_runs(folds).collect()[0]["inds"] == "3_17_20"


def test_every_high_k_point_is_refit(spark):
    q = all_queries()
    d = q["loo_diagnostics"].spark_df(spark, SF_SMALL)
    want = {(r.Country, r.p1, r.p2, r.i) for r in d.filter("refit").collect()}
    assert len({r[:3] for r in want}) > 9  # several countries and models
    folds = q["lko_folds"].spark_df(spark, SF_SMALL).collect()
    assert {(r.Country, r.p1, r.p2, r.i) for r in folds} == want and len(folds) == len(want)
    runs = q["lko_runs"].spark_df(spark, SF_SMALL).collect()
    got = [(r.Country, r.p1, r.p2, int(i)) for r in runs for i in r.inds.split("_")]
    assert sorted(got) == sorted(want)
    assert len({(r.p1, r.p2) for r in runs}) == len({r.Model for r in runs})


def test_corrected_psis_cases(spark):
    keys = ("Country", "p1", "p2")
    pw = [("A", "g", "w", 1, -2.0, 0.1, 0.9), ("A", "g", "w", 2, -3.0, 0.1, 0.2), ("A", "w", "g", 1, -4.0, 0.1, 0.3),
          ("A", "w", "g", 2, -5.0, 0.1, 0.3), ("B", "g", "w", 1, -6.0, 0.1, 0.9), ("B", "g", "w", 2, -7.0, 0.1, 0.9)]
    pw = spark.createDataFrame(pw, "Country string, p1 string, p2 string, i int, elpd_loo double, p_loo double, pareto_k double")
    refit = [("A", "g", "w", 1, -2.5), ("B", "g", "w", 1, -9.0), ("B", "g", "w", 2, -9.0)]
    refit = spark.createDataFrame(refit, "Country string, p1 string, p2 string, ll_ind int, lpd double")
    eligible = spark.createDataFrame([("A", True), ("B", False)], "Country string, loo_eligible boolean")
    got = {r[:3]: r for r in loo.corrected_psis(pw, refit, eligible, FIXTURE, keys).collect()}
    assert got["A", "g", "w"].looic == pytest.approx(10.0) and got["A", "g", "w"].looic_corrected == pytest.approx(11.0)
    assert got["A", "w", "g"].looic == got["A", "w", "g"].looic_corrected == pytest.approx(18.0)
    assert got["B", "g", "w"].looic is None and got["B", "g", "w"].looic_corrected is None
    assert [got[k].n_refit for k in sorted(got)] == [1, 0, 2]


def test_psis_summary_has_every_model(spark):
    rows = all_queries()["psis_summary"].spark_df(spark, SF_SMALL).collect()
    per_country = {}
    for r in rows:
        per_country.setdefault(r.Country, set()).add((r.p1, r.p2))
        assert r.n_refit == r.n_high_pareto_k
        assert (r.looic_corrected is None) == (not r.loo_eligible)
    assert len(rows) == sum(map(len, per_country.values())) and {len(x) for x in per_country.values()} == {9}
