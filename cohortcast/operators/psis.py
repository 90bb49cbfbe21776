"""Draws as matrices: effective sample sizes (L2) and Pareto-smoothed importance sampling (M1) of many series at once.

Spark gathers the draws of an observation or a parameter into one array, ordered by chain and iteration; a series is never
longer than a run has draws.  Tasks take many arrays as the rows of a matrix and sort, fit and sum along its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Draws in one matrix, and numbers in the largest array made from it.
MATRIX = 1 << 20
CUBE = 1 << 23


def ess_rows(x: np.ndarray) -> np.ndarray:
    """Multi-chain effective sample size of each row of ``x`` (rows, chains, iterations): autocovariances by FFT, cut where a
    pair of neighbouring correlations turns negative, pairs made non-increasing; NaN for under four iterations or without
    variation."""
    rows, m, n = x.shape
    if n < 4 or not rows:
        return np.full(rows, np.nan)
    with np.errstate(all="ignore"):
        means = x.mean(axis=2)
        size = 1 << int(np.ceil(np.log2(2 * n)))
        spectrum = np.fft.rfft(x - means[:, :, None], n=size, axis=2)
        autocov = np.fft.irfft(spectrum.real**2 + spectrum.imag**2, n=size, axis=2)[:, :, :n] / n
        within = autocov[:, :, 0].mean(axis=1) * n / (n - 1.0)
        total = within * (n - 1.0) / n
        if m > 1:
            total = total + means.var(axis=1, ddof=1)
        rho = 1.0 - (within[:, None] - autocov.mean(axis=1)) / total[:, None]
        rho[:, 0] = 1.0
        pairs = rho[:, 0 : n - 1 : 2] + rho[:, 1:n:2]
        positive = np.logical_and.accumulate(pairs >= 0, axis=1)
        tau = -1.0 + 2.0 * np.where(positive, np.minimum.accumulate(pairs, axis=1), 0.0).sum(axis=1)
        ess = np.where(positive[:, 0] & (tau > 0), n * m / tau, float(n * m))
    return np.where(np.isfinite(total) & (total > 0), ess, np.nan)


def gpd_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shape and scale of a generalised Pareto distribution for each row (positive, ascending): the profile-posterior mean
    over a grid, with the weak prior on the shape that PSIS uses (Zhang and Stephens 2009; Vehtari et al.)."""
    rows, n = x.shape
    m = 30 + int(np.floor(np.sqrt(n)))
    grid = 1.0 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))
    k, sigma = np.empty(rows), np.empty(rows)
    step = max(1, CUBE // (m * max(m, n)))
    for at in range(0, rows, step):
        part = x[at : at + step]
        quartile = part[:, int(np.floor(n / 4.0 + 0.5)) - 1]
        theta = 1.0 / part[:, -1:] + grid / (3.0 * quartile[:, None])
        shapes = np.log1p(-theta[:, :, None] * part[:, None, :]).mean(axis=2)
        fit = n * (np.log(-theta / shapes) - shapes - 1.0)
        weights = 1.0 / np.exp(fit[:, None, :] - fit[:, :, None]).sum(axis=2)
        best = (theta * weights).sum(axis=1)
        shape = np.log1p(-best[:, None] * part).mean(axis=1)
        sigma[at : at + step] = -shape / best
        k[at : at + step] = (shape * n + 5.0) / (n + 10.0)
    return k, sigma


def log_sum_exp(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    return np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]


def psis_rows(ll: np.ndarray, r_eff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(elpd, Pareto k) of each row of draws of a log likelihood, with relative efficiencies ``r_eff``.

    The largest log ratios of a row are replaced by quantiles of the distribution fitted to them.  A tail of under five
    draws, or of equal ones, stays as it is, with a k of infinity."""
    rows, s = ll.shape
    with np.errstate(all="ignore"):
        ll = -np.sort(-ll, axis=1)  # ratios ascend as likelihoods descend
        lw = ll[:, -1:] - ll
        k = np.full(rows, np.inf)
        tails = np.ceil(np.minimum(0.2 * s, np.where(r_eff > 0, 3.0 * np.sqrt(s / r_eff), np.inf))).astype(int)
        for t in np.unique(tails):
            if t < 5 or t >= s:
                continue
            here = np.flatnonzero(tails == t)
            cut = np.exp(lw[here, s - t - 1])[:, None]
            x = np.exp(lw[here, s - t :]) - cut
            own, sigma = gpd_rows(x)
            own = np.where((x == x[:, :1]).all(axis=1), np.inf, own)
            p = np.log1p(-(np.arange(1, t + 1) - 0.5) / t)
            shape = own[:, None]
            quantile = sigma[:, None] * np.where(shape == 0, -p, np.expm1(-shape * p) / shape)
            lw[here, s - t :] = np.where(np.isfinite(shape), np.log(quantile + cut), lw[here, s - t :])
            lw[here] = np.minimum(lw[here], 0.0)
            k[here] = own
        return log_sum_exp(lw + ll) - log_sum_exp(lw), k


def chain_cube(x: np.ndarray, chains: np.ndarray) -> np.ndarray:
    """Rows of draws, ordered by chain, as (rows, chains, iterations); iterations that a chain lacks are left out of all."""
    _, first, counts = np.unique(chains, return_index=True, return_counts=True)
    return np.stack([x[:, a : a + counts.min()] for a in first], axis=1)


def loo_rows(x: np.ndarray, chains: np.ndarray) -> list[np.ndarray]:
    """elpd, p, looic, Pareto k and relative efficiency (1 where it can't be told) of each row of a log likelihood."""
    s = x.shape[1]
    r_eff = ess_rows(chain_cube(x, chains)) / s
    r_eff = np.where(np.isfinite(r_eff) & (r_eff > 0), r_eff, 1.0)
    elpd, k = psis_rows(x, r_eff)
    return [elpd, log_sum_exp(x) - np.log(s) - elpd, -2.0 * elpd, k, r_eff]


def over_draws(df: DataFrame, keys: list[str], value: str, outputs: list[str],
               rows: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """``keys`` and the ``outputs`` that ``rows`` derives from the draws of ``value`` under each key.

    ``rows`` gets a matrix with one key's draws per row, by chain and iteration, and the chain of each of its columns."""
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("Chain", "Iter", F.col(value).cast("double").alias("v")))).alias("draws"))
    g = g.select(*keys, F.transform("draws", lambda d: d["v"]).alias("draws"), F.transform("draws", lambda d: d["Chain"].cast("int")).alias("chains"))
    schema = T.StructType([g.schema[c] for c in keys] + [T.StructField(c, T.DoubleType()) for c in outputs])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = max(1, len(whole.column(n).flatten()) // max(1, whole.num_rows))
            for at in range(0, whole.num_rows, max(1, MATRIX // size)):
                batch = whole.slice(at, max(1, MATRIX // size))
                values = batch.column(n).flatten().to_numpy(zero_copy_only=False)
                layout = batch.column(n + 1).flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(batch.column(n).value_lengths().to_numpy(zero_copy_only=False))
                starts = np.append(0, ends[:-1])
                alike: dict[bytes, list[int]] = {}
                for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
                    alike.setdefault(layout[a:b].tobytes(), []).append(k)
                out = np.full((len(outputs), batch.num_rows), np.nan)
                for same in alike.values():
                    a, b = starts[same[0]], ends[same[0]]
                    matrix = np.stack([values[starts[k] : ends[k]] for k in same])
                    out[:, same] = rows(matrix, layout[a:b])
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *map(pa.array, out)], names=schema.names)

    return g.mapInArrow(run, schema)
