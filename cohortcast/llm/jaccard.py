"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Words are what stands between ASCII white space, with A-Z lower-cased; a shingle is five words in a row, or all words of
a shorter text.  Texts with the same set of shingles are one class, found by grouping on a digest of the set.

Bands: each of ``TREES`` bands files a class under one key of as many minima, ``DEPTH`` at most, as a formula allows for
a pair at the threshold to share a key with probability ``RECALL`` or more.  The number is fixed before data is read:
this is banding, not a forest whose prefixes are shortened on matches.  The classes under one prefix are candidates for each other; linking each to the least of them, over all trees,
gives candidate clusters.

Verification: a cluster is cut into blocks of bounded size, and each pair of blocks is one unit of work that holds the
shingles of its texts and counts the common ones of every pair exactly.  It returns, per class, the number of linked
texts and a spanning forest of its links, so that no task or table holds all pairs of a group.

A null or empty text has no shingles and links with nothing.  A row with a null id links with nothing either and gets a
null class.  Rows that share an id and a set of shingles are copies; an id with different texts is judged text by text.
Extra columns are not read.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, texts, with_arrow_columns
from .graph import connected_components

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH, RECALL = 32, 12, 0.999
#: Most classes and about the most shingles of a block (bounds the memory of a task, no effect on results).
BLOCK_CLASSES, BLOCK_SHINGLES = 2048, 1_000_000

_MIX = np.random.default_rng(20).integers(0, 1 << 63, size=WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes) -> np.ndarray:
    """The sorted set of 64-bit hashes of the shingles of a text."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    total = np.full(len(words) - size + 1, np.uint64(size) * _MIX[WORDS])
    for k in range(size):
        total += h[k : len(words) - size + 1 + k] * _MIX[k]
    return np.unique(_scramble(total))


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of the threshold's similarity meets with probability ``recall``."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


class Forest:
    """Keys of the trie nodes, one per tree, under which a set is filed at a prefix length."""

    def __init__(self, trees: int, depth: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees, self.depth, n = trees, depth, trees * depth
        self.a = rng.integers(0, 1 << 31, size=(n, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, size=(n, 1), dtype=np.uint32)
        self.mix = rng.integers(0, 1 << 63, size=(trees, depth + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def nodes(self, shingle: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        x = (shingle >> np.uint64(32)).astype(np.uint32)
        for k in range(0, len(x), 1024):
            np.minimum(least, (self.a * x[k : k + 1024] + self.b).min(axis=1), out=least)
        values = least.reshape(self.trees, self.depth).astype(np.uint64)
        return _scramble((values * self.mix[:, : self.depth]).sum(axis=1, dtype=np.uint64) + self.mix[:, -1]).view(np.int64)


def _sets(docs: DataFrame, doc_id: str, text: str, forest: Forest) -> DataFrame:
    """Per row: doc_id, set (digest, null without shingles), size of the set, nodes."""
    adds = [T.StructField("set", T.BinaryType()), T.StructField("n", T.LongType()),
            T.StructField("nodes", T.ArrayType(T.LongType()))]

    def columns(batches):
        for batch in batches:
            digest, n, nodes = [], [], []
            for t in texts(batch, "text"):
                s = shingles(t)
                digest.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                n.append(len(s))
                nodes.append(forest.nodes(s) if len(s) else None)
            yield [pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(nodes, pa.list_(pa.int64()))]

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_arrow_columns(source, ["text"], adds, columns, ["doc_id"])


# ---------------------------------------------------------------- verification


def common(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Numbers of common elements of each pair of sets (``right`` None: of ``left`` with itself)."""
    sets = left if right is None else left + right
    n, owner = len(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows, columns = len(left), n if right is None else len(right)
    first = 0 if right is None else len(left)
    out = np.zeros((rows, columns), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    start = np.cumsum(df) - df
    for size in range(2, 17):  # rare elements: their pairs, one by one
        at = start[df == size]
        if len(at):
            who = owner[at[:, None] + np.arange(size)]
            i, j = np.triu_indices(size, 1)
            a, b = who[:, i].ravel(), who[:, j].ravel()  # owners ascend within an element
            if right is not None:
                apart = (a < first) & (b >= first)
                a, b = a[apart], b[apart] - first
            out += np.bincount(a * columns + b, minlength=rows * columns).reshape(rows, columns).astype(np.float32)
    dense = np.cumsum(df > 16) - 1
    often = np.repeat(df > 16, df)
    number = int(dense[-1]) + 1 if len(dense) else 0
    at, who = dense[column[often]], owner[often]
    for k in range(0, number, 4096):
        width = min(4096, number - k)
        matrix = np.zeros((n, width), np.float32)
        here = (at >= k) & (at < k + width)
        matrix[who[here], at[here] - k] = 1
        product = matrix[:rows] @ matrix[first:].T
        out += np.triu(product, 1) if right is None else product
    return out + out.T if right is None else out


def _linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    count = common(left, right).astype(np.float64)
    a = np.array([len(s) for s in left], float)
    b = a if right is None else np.array([len(s) for s in right], float)
    link = count >= threshold * (a[:, None] + b - count) - 1e-9
    if right is None:
        np.fill_diagonal(link, False)
    return link


def _roots(link: np.ndarray, square: bool) -> np.ndarray:
    """The least vertex of the component of each vertex; of a bipartite matrix, rows come before columns."""
    n = link.shape[0] if square else sum(link.shape)
    label = np.arange(n)
    while True:
        if square:
            new = np.minimum(label, np.where(link, label, n).min(axis=1, initial=n))
        else:
            r, c = label[: link.shape[0]], label[link.shape[0] :]
            new = np.concatenate([np.minimum(r, np.where(link, c, n).min(axis=1, initial=n)),
                                  np.minimum(c, np.where(link, r[:, None], n).min(axis=0, initial=n))])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(work: DataFrame, threshold: float) -> DataFrame:
    """Work rows (unit, side, set, copies, shingles) of a unit lie together; side 0 and 1 are its two blocks, and a unit
    without side 1 compares its block with itself.  Per class with links: set, linked (texts), root (a class)."""
    schema = "set binary, linked long, root binary"

    def solve(rows: list[dict]) -> pa.RecordBatch | None:
        sides: tuple[dict, dict] = {}, {}
        for r in rows:
            sides[r["side"]][r["set"]] = r  # a class once
        keys = [list(s) for s in sides]
        if not keys[0] or len(keys[0]) + len(keys[1]) < 2:
            return None
        sets = [[np.frombuffer(sides[k][x]["shingles"], np.uint64) for x in keys[k]] for k in (0, 1)]
        copies = [np.array([sides[k][x]["copies"] for x in keys[k]], np.int64) for k in (0, 1)]
        square = not keys[1]
        link = _linked(sets[0], None if square else sets[1], threshold)
        if not link.any():
            return None
        names = keys[0] if square else keys[0] + keys[1]
        number = link @ copies[0] if square else np.concatenate([link @ copies[1], link.T @ copies[0]])
        root = _roots(link, square)
        at = np.flatnonzero(number)
        return pa.RecordBatch.from_arrays([
            pa.array([names[i] for i in at], pa.binary()), pa.array(number[at].astype(np.int64)),
            pa.array([names[root[i]] for i in at], pa.binary())], names=["set", "linked", "root"])

    def run(batches):
        unit, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["unit"] != unit:
                    if rows and (done := solve(rows)) is not None:
                        yield done
                    unit, rows = r["unit"], []
                rows.append(r)
        if rows and (done := solve(rows)) is not None:
            yield done

    return work.mapInArrow(run, schema)


# ---------------------------------------------------------------- join


def _judged(docs: DataFrame, threshold: float, trees: int, depth: int, recall: float, doc_id: str,
            text: str) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs``: doc_id and set; per set that has an id: set, component (of sets), rep (its least id),
    class_id and n_links."""
    depth = prefix_length(threshold, trees, depth, recall)
    forest = Forest(trees, depth)
    rows = staged(_sets(docs, doc_id, text, forest), "sets")
    able = rows.filter("doc_id is not null and set is not null")
    classes = able.groupBy("set").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                      F.first("n").alias("n"), F.first("nodes").alias("nodes"))
    classes = staged(classes, "classes")

    filed = classes.select("set", F.explode("nodes").alias("node"))
    nodes = staged(filed.groupBy("node").agg(F.min("set").alias("b"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"), "nodes")
    # joins of the corpus's size are pinned, so that the plan is alike at every size
    edges = filed.join(nodes.hint("merge"), "node").select(F.col("set").alias("a"), "b").filter("a <> b").distinct()
    clusters = connected_components(edges)

    members = staged(clusters.select(F.col("vertex").alias("set"), "component").join(classes.drop("nodes"), "set"), "members")
    blocks = members.groupBy("component").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_CLASSES, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(blocks, "component")
    sources = docs.select(F.col(doc_id).alias("rep"), F.col(text).alias("text"))
    wanted = sources.join(members.hint("merge"), "rep")

    def columns(batches):
        for batch in batches:
            found = [shingles(t) for t in texts(batch, "text")]
            sets = batch.column(batch.schema.get_field_index("set")).to_pylist()
            yield [pa.array([s.tobytes() if blake2b(s.tobytes(), digest_size=16).digest() == d else None
                             for s, d in zip(found, sets, strict=True)], pa.binary())]

    work = with_arrow_columns(wanted, ["text"], [T.StructField("shingles", T.BinaryType())], columns,
                              ["component", "set", "copies", "blocks"]).filter("shingles is not null")
    own = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    work = work.select("component", "set", "copies", "shingles", own.alias("own"), other)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    work = work.select(F.struct("component", low.alias("i"), high.alias("j")).alias("unit"),
                       (F.col("own") > F.col("other")).cast("int").alias("side"), "set", "copies", "shingles")
    work = work.repartition("unit").sortWithinPartitions("unit")
    verified = staged(_verify(work, threshold), "links")

    parts = connected_components(verified.select(F.col("set").alias("a"), F.col("root").alias("b")))
    linked = verified.groupBy("set").agg(F.sum("linked").alias("linked"))
    known = classes.select("set", "rep", "copies").join(parts.select(F.col("vertex").alias("set"), "component"), "set", "left")
    known = staged(known.join(linked, "set", "left").withColumn("component", F.coalesce("component", "set")), "known")
    least = known.groupBy("component").agg(F.min("rep").alias("class_id"))
    known = staged(known.join(least, "component").select(
        "set", "component", "rep", "class_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "judged")
    return rows.select("doc_id", "set"), known


def similar(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL,
            doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (least id that links reach, its own included), n_links (other texts
    of similarity ``threshold`` or more, copies included) and set (digest of its shingles)."""
    rows, known = _judged(docs, threshold, trees, depth, recall, doc_id, text)
    out = rows.join(known.drop("component", "rep"), "set", "left")
    able = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.when(able, F.coalesce("class_id", "doc_id")).alias("class_id"),
                      F.when(able, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), "set")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL,
             doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class of texts: that of the least id, then the least set, then the least row hash.
    An id with different texts has a row in each class that it leads; its rows without shingles are a class of their
    own.  Rows with a null id stay."""
    rows, known = _judged(docs, threshold, trees, depth, recall, doc_id, text)
    first = known.groupBy("component").agg(F.min(F.struct("rep", "set")).alias("first")).select("first.rep", "first.set")
    bare = rows.filter("doc_id is not null and set is null").select("doc_id", F.lit(b"").alias("set")).distinct()
    kept = first.unionByName(bare.withColumnRenamed("doc_id", "rep"))
    own = "_set"
    while own in docs.columns:
        own += "_"
    kept = kept.select(F.col("rep").alias(doc_id), F.col("set").alias(own))

    def columns(batches):
        for batch in batches:
            found = [shingles(t) for t in texts(batch, text)]
            yield [pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b"" for s in found], pa.binary())]

    able = docs.filter(F.col(doc_id).isNotNull())
    marked = with_arrow_columns(able, [text], [T.StructField(own, T.BinaryType())], columns)
    plain = [F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    chosen = marked.join(kept.hint("merge"), [doc_id, own], "left_semi").groupBy(doc_id, own).agg(
        F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias("row")).select("row.*")
    return chosen.unionByName(docs.filter(F.col(doc_id).isNull()))
