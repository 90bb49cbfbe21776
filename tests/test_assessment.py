"""Chain sets, numbering, re-weighting, quantiles and links, each against a plain computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortcast.config import FIXTURE
from cohortcast.functions import densities as dens
from cohortcast.functions import special
from cohortcast.functions.numeric import hash_normal, hash_uniform
from cohortcast.operators import diagnostics as dg
from cohortcast.operators import draws as dr
from cohortcast.operators import likelihood as lk
from cohortcast.operators import prep, psis
from cohortcast.operators.small import numbered


def _ll(spark, rng, n_obs=4, chains=4, iters=25):
    x = rng.normal(-2.0, 0.3, size=(n_obs, chains, iters))
    rows = [("X", i + 1, c + 1, t + 1, c * iters + t, float(x[i, c, t])) for i in range(n_obs) for c in range(chains) for t in range(iters)]
    return x, spark.createDataFrame(rows, "Country string, i int, Chain int, Iter int, Sim long, ll double")


def test_loo_compare_pairs_the_pointwise_differences(spark):
    x, ll = _ll(spark, np.random.default_rng(3))
    pairs = spark.createDataFrame([("X", 0b0101, 0b1010)], "Country string, one int, other int")
    got = dg.loo_compare(dg.loo_of_sets(ll, pairs), pairs).collect()[0]
    side = [psis.loo_rows(x[:, c].reshape(4, -1), np.repeat([0, 1], 25))[0] for c in ([0, 2], [1, 3])]
    diff = side[1] - side[0]
    assert got["n_obs"] == 4
    assert got["elpd_one"] == pytest.approx(side[0].sum()) and got["elpd_other"] == pytest.approx(side[1].sum())
    assert got["elpd_diff"] == pytest.approx(diff.sum()) and got["se_diff"] == pytest.approx(math.sqrt(4 * diff.var(ddof=1)))


def test_chains_in_use(spark):
    verdicts = spark.createDataFrame([(c, "all", ok) for c, ok in [("fine", True), ("drops", False), ("lost", False), ("none_left", False), ("diverges", True)]],
                                     "Country string, subset string, converged boolean")
    flags = spark.createDataFrame([("fine", 0), ("drops", 0), ("lost", 0), ("none_left", 0), ("diverges", 2)], "Country string, n_div long")
    choice = spark.createDataFrame([("fine", 15), ("drops", 8), ("lost", None), ("none_left", 15), ("diverges", 15)], "Country string, discard int")
    got = {r["Country"]: (r["loo_eligible"], r["discard"]) for r in dg.chains_in_use(verdicts, flags, choice, FIXTURE).collect()}
    assert got == {"fine": (True, 0), "drops": (True, 8), "lost": (False, 0), "none_left": (False, 0), "diverges": (False, 0)}
    ll = spark.createDataFrame([("drops", c) for c in (1, 2, 3, 4)] + [("fine", 4)], "Country string, Chain int")
    kept = dg.without_discarded(ll, dg.chains_in_use(verdicts, flags, choice, FIXTURE))
    assert sorted(map(tuple, kept.collect())) == [("drops", 1), ("drops", 2), ("drops", 3), ("fine", 4)]


def test_chains_from_inds(spark):
    inds = spark.createDataFrame([("A", 1), ("A", 50), ("A", 51), ("B", 200)], "Country string, ind int")
    assert sorted(map(tuple, dg.chains_from_inds(inds, 200, 4).collect())) == [("A", 1), ("A", 2), ("B", 4)]


@pytest.mark.parametrize("parts", ["1", "8"])
def test_numbered_counts_through_all_partitions(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(500).select(((F.col("id") * 37) % 251).alias("a"), F.col("id").alias("b")).repartition(7)
        rows = sorted(tuple(r) for r in numbered(df, ["a", "b"], "n").collect())
        empty = numbered(df.filter("a < 0"), ["a"], "n").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [n for *_, n in rows] == list(range(1, 501)) and empty == 0


def test_nb_quantile_is_the_least_value_that_reaches_u():
    rng = np.random.default_rng(5)
    u, mu, k = rng.uniform(1e-9, 1 - 1e-9, 400), rng.choice([0.0, 0.2, 3.0, 80.0, 1e6], 400), rng.choice([0.3, 2.0, 22.0, 1e5], 400)
    y = special.nb_quantile(u, mu, k)
    assert (special.nb_cdf(y, mu, k) >= u).all() and (special.nb_cdf(y - 1, mu, k) < u)[y > 0].all()
    assert (y[mu == 0] == 0).all()
    assert np.isnan(special.nb_quantile([0.5, 0.5, 0.5], [np.nan, 1.0, -1.0], [1.0, 0.0, 1.0])).all()


def test_hash_numbers_look_uniform_and_normal(spark):
    r = spark.range(20000).select(hash_uniform(0, 1, F.col("id")).alias("u"), hash_uniform(1, 1, F.col("id")).alias("v"), hash_normal(1, F.col("id")).alias("z"))
    u, v, z = (np.array(c) for c in zip(*r.collect(), strict=True))
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u, v)[0, 1]) < 0.03
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03


def test_reweighted_summary_by_hand(spark):
    old = spark.createDataFrame([("X", s, 0.0) for s in range(4)], "Country string, Sim long, log_prior double")
    new = spark.createDataFrame([("X", s, float(np.log(w))) for s, w in enumerate([1, 1, 2, 4])], "Country string, Sim long, log_prior double")
    long = spark.createDataFrame([("X", s, "a", v) for s, v in enumerate([4.0, 3.0, 2.0, 1.0])], "Country string, Sim long, param string, value double")
    got = lk.reweighted_summary(long, lk.reweighting(old, new), {"low": 0.25, "mid": 0.6, "high": 0.99}).collect()[0]
    w, v = np.array([1, 1, 2, 4]) / 8, np.array([4.0, 3.0, 2.0, 1.0])
    assert got["mean"] == pytest.approx((w * v).sum()) and got["sd"] == pytest.approx(math.sqrt((w * (v - (w * v).sum()) ** 2).sum()))
    assert (got["low"], got["mid"], got["high"]) == (1.0, 2.0, 4.0) and got["n_eff_weights"] == pytest.approx(1 / (w**2).sum())


def test_prior_with_sigmas_of_one_is_the_fixed_one(spark):
    cols = list(lk.INITIAL_PRIORS)
    rows = [("X", s, t, *[2.0 + 0.1 * t + s + j for j in range(len(cols))]) for s in (0, 1) for t in (1950, 1951, 1952)]
    draws = spark.createDataFrame(rows, "Country string, Sim long, Cohort long, " + ", ".join(f"{c} double" for c in cols))
    sigmas = draws.select("Country", "Sim", *[F.lit(1.0).alias(f"sigma_{c}") for c in cols]).distinct()
    a = {r["Sim"]: r["log_prior"] for r in lk.log_prior(draws).collect()}
    b = {r["Sim"]: r["log_prior"] for r in lk.log_prior_given_sigmas(draws, sigmas).collect()}
    assert a == pytest.approx(b)


def test_dispersion_links(spark):
    coefs = spark.createDataFrame([("X", 0, 1, 0.5), ("X", 0, 2, -1.0)], "Country string, Sim long, k int, beta double")
    basis = spark.createDataFrame([("X", 1, 1, 0.25), ("X", 1, 2, 0.75)], "Country string, Age_i int, k int, value double")
    at = lambda v, b=None: [(r["Age"], r["Dispersion"]) for r in lk.linked_dispersion(coefs, FIXTURE, v, b).orderBy("Age").collect()]
    first = FIXTURE.first_data_age
    assert at("var_unsmooth") == [(first, pytest.approx(1 + math.exp(0.5))), (first + 1, pytest.approx(1 + math.exp(-1.0)))]
    assert at("variable", basis) == [(first, pytest.approx(1 + math.exp(0.125 - 0.75)))]
    assert sorted(d for _, d in at("constant")) == [pytest.approx(math.exp(-1.0)), pytest.approx(math.exp(0.5))]
    with pytest.raises(ValueError, match="poisson"):
        lk.linked_dispersion(coefs, FIXTURE, "poisson")


def test_axis_errors(spark):
    df = spark.createDataFrame([("X", 1950)], "Country string, Cohort int")
    prep.assert_axis(df, "Cohort")
    with pytest.raises(ValueError, match="Time dimension"):
        prep.assert_axis(df, "Period")
    with pytest.raises(ValueError, match="Year not present"):
        prep.assert_axis(df, "Year")


def test_registered_density_equals_the_built_in_one(spark):
    d = spark.createDataFrame([("X", 0, 1950, 2.0, 8.0, 58.0, 5.0, 4.5, 0.3)],
                              "Country string, Sim long, Cohort long, CEB double, mode_age_gap double, mode_age_sum double, sd_1 double, sd_2 double, logit_mixture double")
    with pytest.raises(ValueError, match="unknown density"):
        dr.rate_draws(d, FIXTURE, ("own", "own"))
    dens.register_density("own", dens.DENSITIES["gamma_density"])
    try:
        own = [r["Rate"] for r in dr.rate_draws(d, FIXTURE, ("own", "own")).orderBy("Age").collect()]
    finally:
        dens.DENSITIES.pop("own")
    built = [r["Rate"] for r in dr.rate_draws(d, FIXTURE, ("gamma_density", "gamma_density")).orderBy("Age").collect()]
    assert own == pytest.approx(built)
