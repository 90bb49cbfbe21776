import math

import numpy as np
import pytest

from cohortcast.config import FIXTURE
from cohortcast.operators import diagnostics as dg
from cohortcast.operators import psis


def rhat_segments(x: np.ndarray, n_chains_arg: int) -> float:
    """Segment rule of SURVEY 8.8, written directly: M = 2 n_chains, N = n / M, block i
    holds rows floor(N (i-1)) + 1 .. + floor(N); variances divide by N - 1."""
    n = len(x)
    m = 2 * n_chains_arg
    big_n = n / m
    grand = x.mean()
    means, sms = [], []
    for i in range(1, m + 1):
        start = math.floor(big_n * (i - 1))
        blk = x[start:start + math.floor(big_n)]
        mu = blk.mean()
        means.append(mu)
        sms.append(((blk - mu) ** 2).sum() / (big_n - 1))
    b = sum((mu - grand) ** 2 for mu in means) * big_n / (m - 1)
    w = sum(sms) / m
    return math.sqrt(((big_n - 1) / big_n * w + b / big_n) / w)


def _long(spark, values: np.ndarray, n_chains: int):
    n_iter = values.shape[0] // n_chains
    rows = [("X", "p[1]", int(i // n_iter) + 1, int(i % n_iter) + 1, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "Country string, param string, Chain int, Iter int, value double")


def test_split_rhat_matches_segment_rule(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    got = dg.split_rhat(_long(spark, x, 4), FIXTURE).collect()[0]["rhat"]
    assert got == pytest.approx(rhat_segments(x, 4), rel=1e-12)


def test_fractional_segments_drop_one_chain(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    got = {r["subset"]: r["rhat"] for r in dg.split_rhat(_long(spark, x, 4), FIXTURE, dg.drop_one_chain(FIXTURE)).collect()}
    for c in range(1, 5):
        kept = np.concatenate([x[(k - 1) * 50:k * 50] for k in range(1, 5) if k != c])
        assert got[f"drop_{c}"] == pytest.approx(rhat_segments(kept, 6), rel=1e-12)


def test_rhat_iid_near_one_and_shifted_chain_large(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=2000)
    cfg = FIXTURE.with_(n_draws=2000)
    ok = dg.split_rhat(_long(spark, x, 4), cfg).collect()[0]["rhat"]
    assert ok < 1.05
    y = x.copy()
    y[:500] += 5.0
    bad = dg.split_rhat(_long(spark, y, 4), cfg).collect()[0]["rhat"]
    assert bad > 1.05


def test_ess_iid_close_to_n():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1000, 4))
    assert 3000 < psis.ess_rows(x.T[None])[0] < 5000


def test_ess_autocorrelated_smaller():
    rng = np.random.default_rng(5)
    e = rng.normal(size=(4000, 4))
    x = np.zeros_like(e)
    for t in range(1, len(e)):
        x[t] = 0.9 * x[t - 1] + e[t]
    assert psis.ess_rows(x.T[None])[0] < 1500


def _verdicts(spark, conv, elpd=None):
    v = spark.createDataFrame([("X", k, c) for k, c in conv.items()], "Country string, subset string, converged boolean")
    e = spark.createDataFrame([("X", k, x) for k, x in (elpd or {1: 0.0}).items()], "Country string, bits int, elpd double")
    return dg.chain_choice(v, e, FIXTURE).collect()[0]


def test_chain_choice_takes_all_pairs_whose_removal_converges(spark):
    conv = {f"drop_{c}": False for c in range(1, 5)}
    conv.update({"without_1_2": True, "pair_1_2": False, "without_1_3": True, "pair_1_3": False, "without_1_4": False, "pair_1_4": False})
    r = _verdicts(spark, conv)
    assert (r["decision"], r["discard_chains"], r["keep_chains"]) == ("drop_pair", "1_2_3", "4")
    conv.update({"pair_1_2": True})  # the first of them converges itself: the two sides are compared
    r = _verdicts(spark, conv, {0b0111: -5.0, 0b1000: -9.0})
    assert (r["decision"], r["discard_chains"]) == ("compare_loo", "4")


def test_chain_choice_keeps_converged_pairs(spark):
    conv = {f"drop_{c}": False for c in range(1, 5)}
    conv.update({f"without_1_{j}": False for j in (2, 3, 4)} | {"pair_1_2": False, "pair_1_3": True, "pair_1_4": False})
    r = _verdicts(spark, conv)
    assert (r["decision"], r["keep_chains"]) == ("keep_converged_pairs", "1_3")


def test_chain_choice_drop_one(spark):
    conv = {f"drop_{c}": c == 3 for c in range(1, 5)}
    r = _verdicts(spark, conv)
    assert (r["decision"], r["discard_chains"], r["keep_chains"]) == ("drop_one", "3", "1_2_4")


def test_chain_choice_pairs_and_loo(spark):
    conv = {f"drop_{c}": False for c in range(1, 5)}
    conv.update({"without_1_2": True, "pair_1_2": True, "without_1_3": False, "pair_1_3": False,
                 "without_1_4": False, "pair_1_4": False})
    better_pair = _verdicts(spark, conv, {0b0011: -10.0, 0b1100: -20.0})
    assert (better_pair["decision"], better_pair["discard_chains"]) == ("compare_loo", "3_4")
    worse_pair = _verdicts(spark, conv, {0b0011: -30.0, 0b1100: -20.0})
    assert worse_pair["discard_chains"] == "1_2"


def test_chain_choice_none(spark):
    conv = {f"drop_{c}": False for c in range(1, 5)}
    conv.update({f"{p}_1_{j}": False for p in ("pair", "without") for j in (2, 3, 4)})
    r = _verdicts(spark, conv)
    assert r["decision"] == "none" and r["discard_chains"] is None
