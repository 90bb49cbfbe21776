"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words (the last one takes the rest).  Each passage is described by dense
numbers about its words, which a layer encodes; gated attention, tanh(V h) * sigmoid(U h) weighted by w, gives each
passage its share of the text's representation, and a logistic layer scores that.  Only texts have labels; the attention
learns which passages decide.  Adam fits all weights on the driver from a bounded sample (``SAMPLE`` labelled ids).

Null and empty texts are a bag of one passage of zeros.  Without labels of both kinds every text gets the share of good
ones in the sample, smoothed by half a text of each kind.  Repeated rows are scored alike; a text of any length is
scored whole.  Labels, language, source and id are not inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .common import texts, with_arrow_columns
from .wordstats import WordTable, labelled_sample, letters

SAMPLE = 8_000
PASSAGE = 64
HIDDEN, GATE = 16, 8
EPOCHS, RATE, BATCH, DECAY = 30, 0.01, 128, 1e-4
THRESHOLD = 0.7
NUMBERS = 20


def _describe(word: str) -> tuple[float, ...]:
    upper, alpha, digit, mark, size = letters(word)
    return (upper, alpha, digit, mark, size, float(alpha > 1 and upper == alpha), float(word[-1] in ".!?"),
            float(word[-1] in ",;:"), float(alpha == 0), float(size >= 12), float(size <= 3), float(not word.isascii()),
            float(mark >= 2), float("@" in word or "://" in word), size * size, float(word[0].isupper()))


def passages(numbers: np.ndarray, table: np.ndarray | None) -> np.ndarray:
    """One row of numbers for each passage of a text."""
    n = len(numbers)
    if not n:
        return np.zeros((1, NUMBERS))
    starts = np.arange(0, max(1, n - n % PASSAGE if n >= PASSAGE else 1), PASSAGE)
    sizes = np.diff(np.r_[starts, n]).astype(float)
    s = np.add.reduceat(table[numbers].astype(np.float64), starts, axis=0)
    owner = np.repeat(np.arange(len(starts)), sizes.astype(np.int64))
    pair = np.unique(owner * (len(table) + 1) + numbers) // (len(table) + 1)
    distinct = np.bincount(pair, minlength=len(starts)) / sizes
    same = np.r_[False, numbers[1:] == numbers[:-1]]
    repeats = np.add.reduceat(same.astype(float), starts) / sizes
    mean = s[:, 4] / sizes
    spread = np.sqrt(np.maximum(0, s[:, 14] / sizes - mean**2))
    return np.stack([
        s[:, 0] / np.maximum(1, s[:, 1]), s[:, 1] / s[:, 4], s[:, 2] / s[:, 4], s[:, 3] / s[:, 4], mean / 5, spread / 5,
        s[:, 5] / sizes, s[:, 6] / sizes, s[:, 7] / sizes, s[:, 8] / sizes, s[:, 9] / sizes, s[:, 10] / sizes,
        s[:, 11] / sizes, s[:, 12] / sizes, s[:, 13] / sizes, s[:, 15] / sizes, distinct, repeats, np.log1p(sizes) / 4,
        np.full(len(starts), np.log1p(n) / 8)], axis=1)


def _bags(batch: pa.RecordBatch, text: str, table: WordTable) -> list[np.ndarray]:
    rows = [table.numbers(t.decode().split()) for t in texts(batch, text)]
    every = table.settle()
    return [passages(r, every) for r in rows]


@dataclass
class Attention:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray] | None
    share: float

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """x: passages of all bags, end to end; first: the first passage of each bag."""
        w = self.weights
        owner = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(x)]))
        h = np.tanh(x @ w["encode"] + w["encode_0"])
        v, u = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        e = (v * u) @ w["w"]
        a = np.exp(e - np.maximum.reduceat(e, first)[owner])
        a /= np.add.reduceat(a, first)[owner]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out_0"], -30, 30)))
        return {"x": x, "owner": owner, "h": h, "v": v, "u": u, "a": a, "z": z, "p": p}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags or self.weights is None:
            return np.full(len(bags), self.share)
        first = np.cumsum([0, *map(len, bags)])[:-1]
        return self.forward((np.concatenate(bags) - self.mean) / self.spread, first)["p"]


def _gradient(w: dict[str, np.ndarray], f: dict[str, np.ndarray], y: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss."""
    d = (f["p"] - y) / len(y)
    owner, h, a, v, u = f["owner"], f["h"], f["a"], f["v"], f["u"]
    dz = d[:, None] * w["out"]
    da = (h * dz[owner]).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, first)[owner])
    dvu = de[:, None] * w["w"]
    dv, du = dvu * u * (1 - v**2), dvu * v * u * (1 - u)
    dh = (a[:, None] * dz[owner] + dv @ w["v"].T + du @ w["u"].T) * (1 - h**2)
    return {"out": f["z"].T @ d, "out_0": np.array(d.sum()), "w": (v * u).T @ de, "v": h.T @ dv, "u": h.T @ du,
            "encode": f["x"].T @ dh, "encode_0": dh.sum(axis=0)}


def fit_attention(bags: list[np.ndarray], y: np.ndarray, seed: int = 5) -> Attention:
    share = float((y.sum() + 0.5) / (len(y) + 1))
    if not 0 < y.sum() < len(y):
        return Attention(np.zeros(NUMBERS), np.ones(NUMBERS), None, share)
    every = np.concatenate(bags)
    model = Attention(every.mean(axis=0), every.std(axis=0) + 1e-3, None, share)
    rng = np.random.default_rng(seed)
    shapes = {"encode": (NUMBERS, HIDDEN), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "w": (GATE,), "out": (HIDDEN,)}
    w = {k: rng.normal(size=s) / np.sqrt(s[0]) for k, s in shapes.items()} | {"encode_0": np.zeros(HIDDEN), "out_0": np.array(0.0)}
    model.weights = w
    m, s = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    scaled = [(b - model.mean) / model.spread for b in bags]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            first = np.cumsum([0, *(len(scaled[i]) for i in part)])[:-1]
            f = model.forward(np.concatenate([scaled[i] for i in part]), first)
            step += 1
            for name, g in _gradient(w, f, y[part], first).items():
                g = g + DECAY * w[name]
                m[name] = 0.9 * m[name] + 0.1 * g
                s[name] = 0.999 * s[name] + 0.001 * g * g
                w[name] = w[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", size: int = SAMPLE,
        doc_id: str = "doc_id", text: str = "text") -> Attention:
    """Learn from the labelled ids for which ``learn`` (on ``labels``) holds, ``size`` of them at most."""
    sample = labelled_sample(docs, labels, label, learn, size, doc_id, text)

    def columns(batches):
        table = WordTable(_describe)
        for batch in batches:
            bags = _bags(batch, "text", table)
            table.shrink()
            yield [pa.array([b.astype("<f4").tobytes() for b in bags], pa.binary())]

    rows = with_arrow_columns(sample, ["text"], [T.StructField("bag", T.BinaryType())], columns, ["doc_id", "y"])
    rows = rows.orderBy("doc_id").collect()  # bounded by ``size``
    bags = [np.frombuffer(r.bag, "<f4").reshape(-1, NUMBERS).astype(float) for r in rows]
    return fit_attention(bags, np.array([r.y for r in rows], float))


def score(docs: DataFrame, model: Attention, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the probability of each text to be good."""

    def columns(batches):
        table = WordTable(_describe)
        for batch in batches:
            bags = _bags(batch, text, table)
            table.shrink()
            yield [pa.array(model.scores(bags), pa.float64())]

    return with_arrow_columns(docs, [text], [T.StructField(out, T.DoubleType())], columns, keep)
