"""Embedding near-duplicates by spherical-cap filters.

Filters are the directions of ``CODES`` structured random product codes: after a random rotation the space is cut into
``BLOCKS`` blocks, each with ``CODEWORDS`` unit vectors from randomly signed Hadamard matrices, and every choice of one
codeword per block is a filter.  A vector is listed under all filters whose inner product with it reaches a cut, which
list decoding finds without visiting the others.  The cut is set, per code and dimension, so that a random vector has
``LISTED`` filters on average, or more where that is needed for a pair at the threshold to meet under some filter with
probability ``RECALL`` (as simulated once by each worker).  One code alone lists some vectors often and others never;
independent rotations even this out.  Below ``SMALL`` dimensions a code is one block, and blocks of
less than 32 dimensions have random directions for codewords.

Vectors under one filter are compared with each other in full, by cosine in double precision.  A pair is counted only
under its least common filter.  Filters with many vectors are cut into blocks, and each pair of blocks is a unit of work;
a unit returns, per vector, its number of links and a spanning forest of them, so that no table holds all pairs.

Equal vectors are one class from the start.  A vector that is null, zero, or holds null or non-finite components links
with nothing, nor do vectors of different dimensions with each other.  A null id links with nothing and has a null
component.  An id with several vectors is judged vector by vector.  Extra columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, with_arrow_columns
from .graph import connected_components
from .jaccard import _roots, common

THRESHOLD = 0.95
CODES, BLOCKS, CODEWORDS, LISTED = 6, 2, 1024, 6
RECALL, SMALL = 0.95, 16
#: Most vectors of a block of one filter (bounds the memory of a task, no effect on results).
BLOCK_VECTORS = 1024


def _hadamard(size: int) -> np.ndarray:
    out = np.ones((1, 1))
    while len(out) < size:
        out = np.block([[out, out], [out, -out]])
    return out


class Code:
    """The filters of one code and dimension."""

    def __init__(self, dimension: int, listed: float = LISTED, number: int = 0):
        rng = np.random.default_rng([number, dimension])
        self.base = (dimension << 40) | (number << 32)
        self.rotation = np.linalg.qr(rng.normal(size=(dimension, dimension)))[0]
        self.edges = np.linspace(0, dimension, (BLOCKS if dimension >= SMALL else 1) + 1).astype(int)
        self.books = []
        for width in np.diff(self.edges):
            if width < 32:  # signed Hadamard rows would repeat
                book = rng.normal(size=(CODEWORDS, width))
                self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True))
                continue
            size, book = 1 << int(width - 1).bit_length(), []
            while sum(map(len, book)) < CODEWORDS:
                signs = rng.choice([-1.0, 1.0], size=size)
                rows = _hadamard(size)[:, rng.permutation(size)[:width]] * signs[:width]
                book.append(np.concatenate([rows, -rows]) / np.sqrt(width))
            self.books.append(np.concatenate(book)[:CODEWORDS])
        # the cut that lists as many filters as asked for, over some random vectors
        trial = rng.normal(size=(200, dimension))
        best = np.concatenate([self._highest(self.products(v)) for v in trial / np.linalg.norm(trial, axis=1, keepdims=True)])
        number = min(len(best), int(200 * listed)) - 1
        self.cut = -np.partition(-best, number)[number] - 1e-9

    def products(self, vector: np.ndarray) -> list[np.ndarray]:
        v = vector @ self.rotation
        return [book @ v[a:b] for book, a, b in zip(self.books, self.edges[:-1], self.edges[1:], strict=True)]

    @staticmethod
    def _highest(products: list[np.ndarray], number: int = 4096) -> np.ndarray:
        """The largest sums of one product of each block, ``number`` of them and some more."""
        if len(products) == 1:
            return products[0]
        left, right = (-np.sort(-p) for p in products)
        return np.concatenate([x + right[: number // k] for k, x in enumerate(left[:number], 1)])

    def list(self, products: list[np.ndarray]) -> np.ndarray:
        """Numbers of all filters whose product, the sum of one of each block, reaches the cut."""
        rest = np.cumsum([0.0, *(p.max() for p in products[::-1])])[::-1]  # most that the blocks from here on can add
        sums, number = np.zeros(1), np.zeros(1, np.int64)
        for k, p in enumerate(products):
            able = np.flatnonzero(p + sums.max(initial=-np.inf) + rest[k + 1] >= self.cut) if len(sums) else np.empty(0, int)
            grid = sums[:, None] + p[able]
            i, j = np.nonzero(grid >= self.cut - rest[k + 1])
            sums, number = grid[i, j], number[i] * CODEWORDS + able[j]
        return np.sort(number)

    def filters(self, vector: np.ndarray) -> np.ndarray:
        return self.list(self.products(vector)) + self.base


@lru_cache(maxsize=16)
def listed_for(dimension: int, threshold: float, codes: int = CODES, listed: float = LISTED) -> float:
    """Filters of each code at which pairs of ``threshold`` meet often enough."""
    rng = np.random.default_rng(dimension)
    a, z = (rng.normal(size=(100, dimension)) for _ in range(2))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    b = threshold * a + np.sqrt(1 - threshold**2) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    while listed < CODEWORDS:
        met = [len(np.intersect1d(filters(x, codes, listed), filters(y, codes, listed))) > 0 for x, y in zip(a, b, strict=True)]
        if np.mean(met) >= RECALL:
            break
        listed *= 1.5
    return listed


@lru_cache(maxsize=16)
def _codes(dimension: int, codes: int, listed: float) -> list[Code]:
    return [Code(dimension, listed, k) for k in range(codes)]


def filters(vector: np.ndarray, codes: int = CODES, listed: float = LISTED) -> np.ndarray:
    """All filters of a unit vector, ascending."""
    return np.concatenate([code.filters(vector) for code in _codes(len(vector), codes, listed)])


def _verify(work: DataFrame, threshold: float) -> DataFrame:
    schema = "rep long, h long, linked long, root_rep long, root_h long"

    def solve(unit: dict, rows: list[dict]) -> pa.RecordBatch | None:
        sides: tuple[dict, dict] = {}, {}
        for r in rows:
            sides[r["side"]][(r["rep"], r["h"])] = r
        if not sides[0] or len(sides[0]) + len(sides[1]) < 2:
            return None
        keys = [list(s) for s in sides]
        square = not sides[1]

        def unit_vectors(k: int) -> np.ndarray:
            x = np.stack([np.frombuffer(r["vector"], "<f8") for r in sides[k].values()])
            return x / np.linalg.norm(x, axis=1, keepdims=True)

        left = unit_vectors(0)
        right = left if square else unit_vectors(1)
        link = left @ right.T >= threshold
        if square:
            np.fill_diagonal(link, False)
        if not link.any():
            return None
        # not here if a filter before this one has both
        before = [[(x := np.frombuffer(r["filters"], "<i8"))[x < unit["filter"]] for r in s.values()] for s in sides]
        link &= common(before[0], None if square else before[1]) == 0
        copies = [np.array([r["copies"] for r in s.values()], np.int64) for s in sides]
        names = keys[0] if square else keys[0] + keys[1]
        number = link @ copies[0] if square else np.concatenate([link @ copies[1], link.T @ copies[0]])
        root, at = _roots(link, square), np.flatnonzero(number)
        columns = [[names[i][0] for i in at], [names[i][1] for i in at], number[at], [names[root[i]][0] for i in at],
                   [names[root[i]][1] for i in at]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rep", "h", "linked", "root_rep", "root_h"])

    def run(batches):
        unit, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["unit"] != unit:
                    if rows and (done := solve(unit, rows)) is not None:
                        yield done
                    unit, rows = r["unit"], []
                rows.append(r)
        if rows and (done := solve(unit, rows)) is not None:
            yield done

    return work.mapInArrow(run, schema)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, codes: int = CODES, listed: float = LISTED,
                    vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other vectors with a cosine of ``threshold`` or more that were
    found), component_id (least id that links reach, its own included)."""
    doubles = F.col(embedding).cast("array<double>").alias("vector")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), doubles)
    whole = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) &
                       F.exists("vector", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    able = rows.filter(whole).withColumns({"h": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})
    classes = staged(able.groupBy("h", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                                 F.first("vector").alias("vector")), "vectors")

    def columns(batches):
        for batch in batches:
            found, raw = [], []
            for v in batch.column(batch.schema.get_field_index("vector")).to_pylist():
                x = np.array(v, "<f8")
                x = x / np.abs(x).max()  # squares of very small or large numbers would vanish or overflow
                raw.append(x.tobytes())
                found.append(filters(x / np.linalg.norm(x), codes, listed_for(len(x), threshold, codes, listed)))
            yield [pa.array([x.astype("<i8").tobytes() for x in found], pa.binary()), pa.array(found, pa.list_(pa.int64())),
                   pa.array(raw, pa.binary())]

    adds = [T.StructField("filters", T.BinaryType()), T.StructField("each", T.ArrayType(T.LongType())),
            T.StructField("vector", T.BinaryType())]
    listed_rows = staged(with_arrow_columns(classes, ["vector"], adds, columns, ["rep", "h", "copies"]), "filters")
    filed = listed_rows.select("rep", "h", F.explode("each").alias("filter"))
    sizes = filed.groupBy("filter").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = sizes.select("filter", F.ceil(F.col("n") / BLOCK_VECTORS).cast("int").alias("blocks"))
    shared = filed.join(sizes, "filter")
    own = F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int").alias("own")
    spread = shared.select("filter", "rep", "h", own, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    unit = F.struct("filter", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("unit")
    spread = spread.select(unit, (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "h")
    work = spread.join(listed_rows.select("rep", "h", "copies", "filters", "vector"), ["rep", "h"])
    work = work.repartition("unit").sortWithinPartitions("unit")
    verified = staged(_verify(work, threshold), "near")

    vertex, root = F.struct("rep", "h"), F.struct(F.col("root_rep").alias("rep"), F.col("root_h").alias("h"))
    parts = connected_components(verified.select(vertex.alias("a"), root.alias("b")))
    parts = parts.select("vertex.rep", "vertex.h", F.col("component.rep").alias("component_id"))
    linked = verified.groupBy("rep", "h").agg(F.sum("linked").alias("linked"))
    known = classes.select("h", "h2", "rep", "copies").join(linked, ["rep", "h"], "left").join(parts, ["rep", "h"], "left")
    known = staged(known.select("h", "h2", F.coalesce("component_id", "rep").alias("component_id"),
                                (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "known")
    out = able.select("vec_id", "h", "h2").join(known, ["h", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~whole).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone)
