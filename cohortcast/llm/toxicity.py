"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A bounded sample of labelled texts (``SAMPLE`` ids) is split by a hash into three parts.  The first teaches a lexicon:
words and word beginnings whose share of toxic texts far exceeds that of others; a short list of insults joins it.  The
second fits the trees (Newton steps for the logistic loss, on binned features).  The third maps their sums to
probabilities by isotonic regression.

Features of a text, all from sums over its words: densities and counts of lexicon hits, the share of hits with a second
person nearby, second persons, capitals, words in capitals, punctuation, exclamations, digits, obfuscation (digits or
symbols inside a word, stretched letters), word length and text length.

Null texts count as empty; an empty text has all features 0 and gets the score of such.  Without labels of both kinds
every text gets the share of toxic ones in the sample, smoothed by half a text of each kind.  Repeated rows are scored
alike.  Labels, language, source and id are not features.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts, with_arrow_columns
from .wordstats import WordTable, labelled_sample, letters

SAMPLE = 12_000
#: Parts of the sample, in thousandths: lexicon, trees, calibration.
PARTS = (400, 800)
THRESHOLD = 0.7
#: A lexicon entry occurs in toxic texts so many times as often (log of the odds), and in so many at least.
LEAST_ODDS, LEAST_TEXTS, LEAST_SHARE = 2.5, 3, 0.004
LEXICON = 4000
BEGINNINGS = (4, 5, 6)
#: Fixed values.
INSULTS = frozenset("idiot moron stupid scum trash pathetic worthless disgusting loser clown dumb jerk".split())
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine "
                          "euch euer ihr usted ti tuyo vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi")
NEAR = 5

TREES, DEPTH, RATE, BINS, LEAST_WEIGHT, RIDGE = 60, 4, 0.2, 64, 3.0, 1.0


def plain(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}<>*_~#&%$-").lower()


def beginnings(word: str) -> list[str]:
    return [word[:n] + "*" for n in BEGINNINGS if len(word) > n]


# ---------------------------------------------------------------- features


def _describe(lexicon: dict[str, float]):
    def describe(word: str) -> tuple[float, ...]:
        upper, alpha, digit, mark, size = letters(word)
        core = plain(word)
        spelt = core.translate(LEET)
        inner = core[1:-1]
        obfuscated = bool(inner) and alpha > 0 and (spelt != core and not core.isdigit() or not inner.isalnum() and not
                                                    any(x in inner for x in "@.-'/"))
        stretched = any(spelt[k] == spelt[k + 1] == spelt[k + 2] for k in range(len(spelt) - 2))
        seed = core in INSULTS or spelt in INSULTS
        entry = max(lexicon.get(core, 0.0), lexicon.get(spelt, 0.0))
        start = max((lexicon.get(b, 0.0) for w in {core, spelt} for b in beginnings(w)), default=0.0)
        return (float(seed), float(entry > 0), float(start > 0), max(entry, start), float(core in SECOND_PERSON), upper,
                alpha, digit, mark, size, float(alpha > 1 and upper == alpha), word.count("!"), float(obfuscated), float(stretched))

    return describe


FEATURES = 20


def features(rows: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), FEATURES))
    for k, numbers in enumerate(rows):
        n = len(numbers)
        if not n:
            continue
        x = table[numbers]
        sums = x.sum(axis=0, dtype=np.float64)
        hit = x[:, :3].any(axis=1)
        hits = int(hit.sum())
        near = 0.0
        if hits and sums[4]:
            second = np.r_[0, np.cumsum(x[:, 4])]
            at = np.flatnonzero(hit)
            near = float(np.mean(second[np.minimum(at + NEAR + 1, n)] > second[np.maximum(at - NEAR, 0)]))
        out[k] = [sums[0] / n, sums[1] / n, sums[2] / n, hits / n, np.log1p(sums[0]), np.log1p(sums[1]), np.log1p(sums[2]),
                  np.log1p(hits), float(x[:, 3].max()), sums[3] / n, near, sums[4] / n, sums[5] / max(1.0, sums[6]),
                  sums[10] / n, sums[8] / sums[9], sums[11] / n, sums[7] / sums[9], (sums[12] + sums[13]) / n, sums[9] / n,
                  np.log1p(n)]
    return out


def _featured(docs: DataFrame, lexicon: dict[str, float], text: str, keep: list[str]) -> DataFrame:
    def columns(batches):
        table = WordTable(_describe(lexicon))
        for batch in batches:
            rows = [table.numbers(t.decode().split()) for t in texts(batch, text)]
            x = features(rows, table.settle())
            table.shrink()
            yield [pa.array(list(x), pa.list_(pa.float64()))]

    return with_arrow_columns(docs, [text], [T.StructField("features", T.ArrayType(T.DoubleType()))], columns, keep)


# ---------------------------------------------------------------- lexicon


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Log-odds of words and beginnings (with ``*``) that mark toxic texts; at most ``LEXICON`` entries."""

    def run(batches):
        for batch in batches:
            seen, toxic = Counter(), Counter()
            for t, y in zip(texts(batch, "text"), batch.column(1).to_pylist(), strict=True):
                own = {plain(w) for w in t.decode().split()} - {""}
                own |= {b for w in own for b in beginnings(w)}
                seen.update(own)
                if y:
                    toxic.update(own)
            names = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([seen[w] for w in names], pa.int64()),
                 pa.array([toxic[w] for w in names], pa.int64())], names=["entry", "n", "toxic"])

    size = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).first()
    if not 0 < size.toxic < size.n:
        return {}
    counts = (sample.select("text", "y").mapInArrow(run, "entry string, n long, toxic long")
              .groupBy("entry").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")))
    odds = (F.log((F.col("toxic") + 0.5) / (size.toxic + 1)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (size.n - size.toxic + 1)))
    least = max(LEAST_TEXTS, LEAST_SHARE * size.toxic)
    rows = (counts.filter(F.col("toxic") >= least).withColumn("odds", odds).filter(F.col("odds") > LEAST_ODDS)
            .orderBy(F.desc("odds"), "entry").limit(LEXICON).collect())
    return {r.entry: r.odds for r in rows}


# ---------------------------------------------------------------- trees


@dataclass
class Trees:
    cuts: list[np.ndarray]  # of each feature
    splits: np.ndarray  # (trees, inner nodes, 2): feature and last bin to the left
    leaves: np.ndarray  # (trees, leaves)
    bias: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1)

    def sums(self, x: np.ndarray) -> np.ndarray:
        b, out = self.bins(x), np.full(len(x), self.bias)
        every = np.arange(len(x))
        for split, leaf in zip(self.splits, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[every, split[node, 0]] > split[node, 1])
            out += leaf[node - len(split)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees of ``DEPTH`` levels by histograms of gradients."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1], method="inverted_cdf")) for f in range(x.shape[1])]
    # a feature that is nearly always 0 has few quantiles; cut its positive part as well
    for f in range(x.shape[1]):
        positive = x[x[:, f] > 0, f]
        if 0 < len(positive) < 0.5 * len(x):
            more = np.quantile(positive, np.linspace(0, 1, BINS // 2)[:-1], method="inverted_cdf")
            cuts[f] = np.unique(np.r_[0.0, cuts[f], more])[: 2 * BINS]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(cuts, np.zeros((0, 2**DEPTH - 1, 2), np.int64), np.zeros((0, 2**DEPTH)), float(np.log(share / (1 - share))))
    width = 2 * BINS + 1
    binned = model.bins(x)
    total, n_features = np.full(len(x), model.bias), x.shape[1]
    splits, leaves = [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        split = np.zeros((2**DEPTH - 1, 2), np.int64)
        split[:, 1] = width  # all to the left
        for level in range(DEPTH):
            first, size = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * n_features + np.arange(n_features)) * width + binned
            shape = (size, n_features, width)
            gs = np.bincount(cell.ravel(), np.repeat(g, n_features), size * n_features * width).reshape(shape).cumsum(axis=2)
            hs = np.bincount(cell.ravel(), np.repeat(h, n_features), size * n_features * width).reshape(shape).cumsum(axis=2)
            g_all, h_all = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + RIDGE) + (g_all - gs) ** 2 / (h_all - hs + RIDGE) - g_all**2 / (h_all + RIDGE)
            gain[(hs < LEAST_WEIGHT / 4) | (h_all - hs < LEAST_WEIGHT / 4)] = 0
            flat = gain.reshape(size, -1)
            best = flat.argmax(axis=1)
            good = flat[np.arange(size), best] > 1e-6
            split[first : first + size, 0] = np.where(good, best // width, 0)
            split[first : first + size, 1] = np.where(good, best % width, width)
            node = 2 * node + 1 + (binned[np.arange(len(x)), split[node, 0]] > split[node, 1])
        leaf = node - len(split)
        value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + RIDGE)
        total += value[leaf]
        splits.append(split), leaves.append(value)
    model.splits, model.leaves = np.stack(splits), np.stack(leaves)
    return model


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step function nearest to (x, y) (pool adjacent violators), joined by lines."""
    at, inverse = np.unique(x, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, y) / weight
    pools: list[list[float]] = []  # mean, weight, first and last knot
    for k in range(len(at)):
        pools.append([mean[k], weight[k], at[k], at[k]])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m, w, _, last = pools.pop()
            p = pools[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, last
    return np.array([v for p in pools for v in p[2:4]]), np.array([p[0] for p in pools for _ in (0, 1)])


# ---------------------------------------------------------------- model


@dataclass
class Toxicity:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        return np.clip(np.interp(self.trees.sums(x), *self.knots), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", size: int = SAMPLE,
        doc_id: str = "doc_id", text: str = "text") -> Toxicity:
    """Learn from the labelled ids for which ``learn`` (on ``labels``) holds, ``size`` of them at most."""
    sample = labelled_sample(docs, labels, label, learn, size, doc_id, text)
    lexicon = learn_lexicon(sample.filter(F.col("u") < PARTS[0]))
    rest = _featured(sample.filter(F.col("u") >= PARTS[0]), lexicon, "text", ["y", "u"]).collect()  # bounded by ``size``
    y = np.array([r.y for r in rest], float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    x = np.array([r.features for r in rest]).reshape(len(rest), FEATURES)
    last = np.array([r.u for r in rest]) >= PARTS[1]
    if not all(0 < y[part].sum() < part.sum() for part in (last, ~last)):
        return Toxicity(lexicon, None, None, float(share))
    trees = fit_trees(x[~last], y[~last])
    return Toxicity(lexicon, trees, isotonic(trees.sums(x[last]), y[last]), float(share))


def score(docs: DataFrame, model: Toxicity, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the probability of each text to be toxic."""

    def columns(batches):
        table = WordTable(_describe(model.lexicon))
        for batch in batches:
            rows = [table.numbers(t.decode().split()) for t in texts(batch, text)]
            x = features(rows, table.settle())
            table.shrink()
            yield [pa.array(model.scores(x))]

    return with_arrow_columns(docs, [text], [T.StructField(out, T.DoubleType())], columns, keep)
