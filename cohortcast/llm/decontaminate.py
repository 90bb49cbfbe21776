"""Benchmark decontamination by suffix arrays of the training documents.

Words are runs of ASCII letters (lower-cased) and digits and of all characters beyond ASCII.  The documents of a
partition form shards of about ``SHARD`` words; each shard gets a suffix array over its words, to the depth of the
longest item, by prefix doubling.  Words that no item holds become one breaking symbol, so the array lists the suffixes
that begin with a word of the benchmark.  Every suffix of every test item is binary-searched in every shard.  A test
suffix of a window (13 words, or a whole shorter item) or more gives the places of its window in the training text; and
as a text's longest match at a place is with the test suffix next above or below it, the same search gives each document's
longest verbatim match, where it starts, and in which item.  ``longest_matches`` lists the longest matches from the side of
the test suffixes.

The benchmark is a stated query set.  It is taken in blocks of about ``BLOCK_BYTES`` of text, and each block goes to all
tasks with the function that searches it (Spark broadcasts large ones).  The driver collects one block after the other.  The
blocks follow each other within the same pass over the documents, which are never shuffled.

A shard is built of the documents that a task gets at a time and holds whole documents, so a very long text is a shard of
its own, in memory.
Null and empty texts have no words.  Items without words, and a null item text, match nothing; a null item id is listed
as the empty string, and items that share an id count once.  Repeated documents are judged one by one.  With an empty
benchmark nothing is hit.  Of equally long matches the first in the document counts, and there that in the item with the
smallest id, then at its earliest word.  Input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import renamed, texts, unnamed, with_arrow_columns

WINDOW = 13
SHARD = 1 << 20
BLOCK_BYTES = 16 << 20
#: What one block of items finds and the next adds to.
FOUND = ("items", "hit_words", "longest", "longest_word", "longest_item", "longest_item_word")

_BLANK = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(_BLANK).split()  # bytes.lower() changes A-Z only


class Benchmark:
    """Items as runs of word numbers from 1; the numbers of a run end with 0."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        runs, self.names, owner = [], [], []
        for name, text in items:
            run = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            if run:
                owner += [len(self.names)] * (len(run) + 1)
                self.names.append(name)
                runs.append(run)
        self.bits = max(1, len(self.number).bit_length())
        self.step = max(1, min(62 // self.bits, 16))  # words that one key holds
        self.codes = np.array([x for run in runs for x in [*run, 0]], np.int64)
        self.owner = np.array(owner, np.int64)
        self.longest = max(map(len, runs), default=0)
        self.keys = pack(self.codes, self.step, self.bits)
        # words from each place to the end of its item, and the windows that start there
        left = np.concatenate([np.arange(len(run), -1, -1) for run in runs]) if runs else np.empty(0, np.int64)
        first = np.r_[True, left[:-1] == 0] if len(left) else np.empty(0, bool)
        self.left = left
        self.starts = np.flatnonzero((left >= window) | (first & (left > 0)))
        self.sizes = np.minimum(left[self.starts], window)
        # all suffixes in order, and how many words each shares with the one before it
        self.array = suffix_array(self.codes, self.keys, self.step, self.longest)
        self.shared = np.zeros(len(self.array), np.int64)
        self.shared[1:] = common(self.keys, self.array[:-1], self, self.array[1:])
        self.item_first = np.searchsorted(self.owner, np.arange(len(self.names)))

    def earliest(self, ranks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The smallest place whose suffix begins with the ``sizes`` words of the suffixes of these ranks."""
        out = np.zeros(len(ranks), np.int64)
        for size in np.unique(sizes):
            heads = np.flatnonzero(np.r_[True, self.shared[1:] < size])  # runs of suffixes with the same first words
            least = np.minimum.reduceat(self.array, heads)
            on = sizes == size
            out[on] = least[np.searchsorted(heads, ranks[on], side="right") - 1]
        return out


def pack(codes: np.ndarray, step: int, bits: int) -> np.ndarray:
    """At each place, the next ``step`` codes as one number (0 beyond the end)."""
    padded = np.concatenate([codes, np.zeros(step, np.int64)])
    out = np.zeros(len(codes), np.int64)
    for k in range(step):
        out = (out << bits) | padded[k : k + len(codes)]
    return out


def suffix_array(codes: np.ndarray, keys: np.ndarray, step: int, depth: int) -> np.ndarray:
    """Places with a code above 0, sorted by the ``depth`` codes (or more) that follow."""
    places = np.flatnonzero(codes)
    if not len(places):
        return places
    order = np.argsort(keys[places], kind="stable")
    places = places[order]
    value = keys[places]
    rank = np.zeros(len(codes) + depth + step, np.int64)
    head = np.r_[True, value[1:] != value[:-1]]
    group = np.maximum.accumulate(np.where(head, np.arange(len(places)), 0))  # first index of each run of ties
    rank[places] = group + 1
    while step < depth:
        same = np.r_[False, ~head[1:]]
        tied = same | np.r_[same[1:], False]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own, after = group[at], rank[places[at] + step]
        order = np.lexsort([after, own])
        places[at] = places[at][order]
        after, own = after[order], own[order]
        head[at] = np.r_[True, (own[1:] != own[:-1]) | (after[1:] != after[:-1])]
        group = np.maximum.accumulate(np.where(head, np.arange(len(places)), 0))
        rank[places] = group + 1
        step *= 2
    return places


def search(array: np.ndarray, keys: np.ndarray, bench: Benchmark, starts: np.ndarray, size: int, right: bool) -> np.ndarray:
    """First index in ``array`` whose suffix is not below (``right``: is above) the ``size`` words from each start."""
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(array), np.int64)
    step, bits = bench.step, bench.bits
    while (on := np.flatnonzero(low < high)).size:
        middle = (low[on] + high[on]) >> 1
        place, query = array[middle], starts[on]
        below, open_ = np.zeros(len(on), bool), np.ones(len(on), bool)
        for k in range(0, size, step):
            drop = bits * max(0, step - (size - k))
            at = place + k
            mine = np.where(at < len(keys), keys[np.minimum(at, len(keys) - 1)], 0) >> drop
            theirs = bench.keys[np.minimum(query + k, len(bench.keys) - 1)] >> drop
            below |= open_ & (mine < theirs)
            open_ &= mine == theirs
        if right:
            below |= open_
        low[on] = np.where(below, middle + 1, low[on])
        high[on] = np.where(below, high[on], middle)
    return low


def common(keys: np.ndarray, places: np.ndarray, bench: Benchmark, starts: np.ndarray) -> np.ndarray:
    """How many words the text with ``keys`` has in common, from each place, with the test suffix from each start."""
    out, on, k = np.zeros(len(starts), np.int64), np.arange(len(starts)), 0
    left = bench.left[starts]
    while len(on):
        differ = keys[places[on] + k] ^ bench.keys[starts[on] + k]
        high = differ >> 31  # in two halves, which are exact as doubles
        width = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 31, np.frexp(differ.astype(np.float64))[1])
        out[on] = k + (bench.step * bench.bits - width) // bench.bits
        k += bench.step
        on = on[(differ == 0) & (k < left[on])]  # so all words until here are words of the text as well
    return np.minimum(out, left)


class Shard:
    """Some documents with the suffix array of their words."""

    def __init__(self, documents: list[list[bytes]], bench: Benchmark):
        self.bench = bench
        self.sizes = np.array([len(d) for d in documents], np.int64)
        ends = np.cumsum(self.sizes + 1)
        self.first = ends - self.sizes - 1
        codes = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)  # a 0 ends each document
        for d, at in zip(documents, self.first.tolist(), strict=True):
            codes[at : at + len(d)] = np.fromiter(map(bench.number.get, d, repeat(0)), np.int64, len(d))
        self.codes = codes
        self.keys = pack(codes, bench.step, bench.bits)
        self.array = suffix_array(codes, self.keys, bench.step, bench.longest)

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, size and start (in the benchmark) of every occurrence of a window."""
        b, found = self.bench, []
        for size in np.unique(b.sizes):
            starts = b.starts[b.sizes == size]
            low = search(self.array, self.keys, b, starts, int(size), False)
            number = search(self.array, self.keys, b, starts, int(size), True) - low
            hit = np.flatnonzero(number)
            n = number[hit]
            index = np.arange(n.sum()) + np.repeat(low[hit] - np.cumsum(n) + n, n)
            found.append((self.array[index], np.full(len(index), size), np.repeat(starts[hit], n)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3

    def longest_by_document(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each document the size of its longest match (0: none), its place, and its start in the benchmark."""
        b, size, place = self.bench, np.zeros(len(self.sizes), np.int64), self.first.copy()
        start = np.zeros(len(self.sizes), np.int64)
        if not len(self.array) or not len(b.array):
            return size, place, start
        at = search(self.array, self.keys, b, b.array, b.longest, False)  # ascending, as the test suffixes are
        upper = np.cumsum(np.bincount(at, minlength=len(self.array) + 1))[: len(self.array)]
        below, above = np.maximum(upper - 1, 0), np.minimum(upper, len(b.array) - 1)
        one, two = (common(self.keys, self.array, b, b.array[rank]) for rank in (below, above))
        match, rank = np.zeros((2, len(self.codes)), np.int64)
        match[self.array], rank[self.array] = np.maximum(one, two), np.where(two > one, above, below)
        best = np.maximum.reduceat((match << 32) - np.arange(len(match)), self.first)  # the longest, then the first
        size = (best + len(match)) >> 32
        found = np.flatnonzero(size)
        place[found] = (size[found] << 32) - best[found]
        start[found] = b.earliest(rank[place[found]], size[found])
        return size, place, start

    def longest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, size and place of the longest match of every test suffix (sizes above 0)."""
        b = self.bench
        starts = np.flatnonzero(b.left)
        size, place = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if len(self.array):
            at = search(self.array, self.keys, b, starts, b.longest, False)
            for index in (at - 1, at):
                there = self.array[np.clip(index, 0, len(self.array) - 1)]
                common, on = np.zeros(len(starts), np.int64), np.flatnonzero((index >= 0) & (index < len(self.array)))
                k = 0
                while len(on):
                    on = on[(there[on] + k < len(self.codes)) & (k < b.left[starts[on]])]
                    on = on[self.codes[there[on] + k] == b.codes[starts[on] + k]]
                    common[on] = k = k + 1
                better = common > size
                size[better], place[better] = common[better], there[better]
        keep = size > 0
        return starts[keep], size[keep], place[keep]

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1


def _shards(rows: Iterator[list[bytes]]) -> Iterator[list[list[bytes]]]:
    shard, size = [], 0
    for row in rows:
        shard.append(row)
        size += len(row)
        if size >= SHARD:
            yield shard
            shard, size = [], 0
    if shard:
        yield shard


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """How many blocks there are, and the blocks, collected one by one."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"),
                             F.coalesce(F.col(text), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t") + 32)).first()[0] or 0
    number = max(1, -(-total // BLOCK_BYTES))
    parts = (items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(number)) == k).collect() for k in range(number))
    return number, (sorted((r.i, r.t.encode()) for r in part) for part in parts)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside an occurrence of a window of ``window`` item words, or of a whole
    shorter item), items (sorted ids, as strings, of the items with an occurrence), hit_words (one bit per word, in
    ``numpy.packbits`` order; null without a hit), and the longest verbatim match with any item: longest (words; 0: none),
    longest_word (where in the document, from 0), longest_item (its id) and longest_item_word (where in the item)."""
    adds = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hit_words", T.BinaryType()),
            T.StructField("longest", T.LongType()), T.StructField("longest_word", T.LongType()),
            T.StructField("longest_item", T.StringType()), T.StructField("longest_item_word", T.LongType())]
    kept = list(docs.columns if keep is None else keep)
    out = docs.select(*dict.fromkeys([c for c in [*kept, text] if c not in {f.name for f in adds}]))
    out = out.withColumns({f.name: F.lit(None).cast(f.dataType) for f in adds if f.name in FOUND})
    number, blocks = _blocks(benchmark, item_id, item_text)
    for k, block in enumerate(blocks, 1):
        out = _search(out, block, window, text, adds, kept if k == number else list(dict.fromkeys([*kept, text])))
    return out


def _search(docs: DataFrame, block: list[tuple[str, bytes]], window: int, text: str, adds: list[T.StructField],
            carried: list[str]) -> DataFrame:
    """Adds the hits of one block of items to those that ``docs`` has."""

    def columns(batches):
        bench = Benchmark(block, window)
        for batch in batches:
            before_items, before_bits, *before = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in FOUND)
            before = list(zip(*before, strict=True))
            n_words, n_hit, items, bits, matches, row = [], [], [], [], [], 0
            for documents in _shards(words(t) for t in texts(batch, text)):
                shard = Shard(documents, bench)
                place, size, start = shard.occurrences()
                edges = np.bincount(place, minlength=len(shard.codes) + 1)
                covered = np.cumsum(edges - np.bincount(place + size, minlength=len(shard.codes) + 1)) > 0
                pairs = np.unique(shard.document(place) * max(1, len(bench.names)) + bench.owner[start])
                named: dict[int, set[str]] = {}
                for p in pairs.tolist():
                    d, i = divmod(p, len(bench.names))
                    named.setdefault(d, set()).add(bench.names[i])
                longest, where, start = shard.longest_by_document()
                owner = bench.owner[start] if len(bench.names) else start
                word = (start - bench.item_first[owner] if len(bench.names) else start).tolist()
                match = zip(longest.tolist(), (where - shard.first).tolist(), owner.tolist(), word, strict=True)
                for (size, w, i, iw), old in zip(match, before[row : row + len(documents)], strict=True):
                    own = (size, w, bench.names[i], iw) if size else (0, None, None, None)
                    matches.append(min((own, old), key=_best) if old[0] else own)
                for d, (a, n) in enumerate(zip(shard.first.tolist(), shard.sizes.tolist(), strict=True)):
                    old_items, old_bits = before_items[row], before_bits[row]
                    hit = covered[a : a + n] if d in named else None
                    if old_bits is not None:
                        old = np.unpackbits(np.frombuffer(old_bits, np.uint8), count=n).astype(bool)
                        hit = old if hit is None else hit | old
                    n_words.append(n)
                    n_hit.append(0 if hit is None else int(hit.sum()))
                    items.append(sorted({*(old_items or ()), *named.get(d, ())}))
                    bits.append(None if hit is None else np.packbits(hit).tobytes())
                    row += 1
            yield [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())),
                   pa.array(bits, pa.binary()),
                   *(pa.array([m[k] for m in matches], pa.string() if k == 2 else pa.int64()) for k in range(4))]

    return with_arrow_columns(docs, [text, *FOUND], adds, columns, carried)


def _best(match: tuple) -> tuple:
    """Orders matches (size, word, item, word of the item): the longest first, none last."""
    return (-match[0], *match[1:]) if match[0] else (0,)


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, text: str = "text",
                    doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The longest verbatim match of every test suffix in all documents, from ``least`` words on: item_id (string),
    item_word (where the suffix starts), n_words, doc_id and doc_word (where it matches; of several equally long
    matches that in the smallest doc_id, then the first one found there)."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()),
                           T.StructField("n_words", T.LongType()), T.StructField("doc_id", kind),
                           T.StructField("doc_word", T.LongType())])
    found = None
    for block in _blocks(benchmark, item_id, item_text)[1]:

        def run(batches, block=block):
            bench = Benchmark(block, least)
            for batch in batches:
                row = 0
                ids = batch.column(0)
                for documents in _shards(words(t) for t in texts(batch, text)):
                    shard = Shard(documents, bench)
                    start, size, place = shard.longest()
                    on = size >= least
                    start, size, place = start[on], size[on], place[on]
                    d = shard.document(place)
                    item = bench.owner[start]
                    first = np.searchsorted(bench.owner, item)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bench.names[i] for i in item], pa.string()), pa.array(start - first), pa.array(size),
                         ids.take(pa.array(d + row)), pa.array(place - shard.first[d])], names=schema.names)
                    row += len(documents)

        part = docs.select(doc_id, text).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    best = F.max_by(F.struct("doc_id", "doc_word"), F.struct("n_words", -F.col("doc_id"), -F.col("doc_word")))
    if not isinstance(kind, T.NumericType):
        best = F.max_by(F.struct("doc_id", "doc_word"), F.struct("n_words", "doc_id", -F.col("doc_word")))
    return (found.groupBy("item_id", "item_word").agg(F.max("n_words").alias("n_words"), best.alias("b"))
            .select("item_id", "item_word", "n_words", "b.doc_id", "b.doc_word"))


def contaminated(share: int = 20) -> Column:
    """Of the columns of :func:`contamination`: at least one word in ``share`` is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, text: str = "text",
                  **names: str) -> DataFrame:
    """``docs`` without the contaminated documents."""
    rows, own = unnamed(docs)
    judged = contamination(rows, benchmark, window, text=own[text], **names)
    return renamed(judged.filter(~contaminated(share)), own)
