"""Token files: ids of a public tokenizer, in a canonical length-limited Huffman code.

A file set is a folder with two Parquet tables, so that any store that Spark reads can hold it:

``codebook``  one row per id that occurs: id, bits (code length, at most ``MAX_BITS``).  Codes are canonical: they count
              up in order of (bits, id).
``segments``  one row per run of whole documents in ascending order: file, segment, file_start (ids of the same file
              before the segment), doc_ids, doc_sizes, payload (the codes, most significant bit first, end to end),
              checkpoints (bit offset of every ``BLOCK``-th id, little-endian unsigned 32-bit integers).

A checkpoint starts a block that decodes without its predecessors; the reader decodes all blocks of a segment side by
side, one table look-up per id.  The code lengths come from counts over all ids, by package-merge.

Null and empty texts hold only the end id.  Rows with a null doc_id come first; rows that share a doc_id are ordered by
a checksum and then by their ids, so equal rows are interchangeable.  An empty table gives an empty file set, which reads back as no rows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .common import staged, with_arrow_columns

MAX_BITS = 20
BLOCK = 256
#: Ids after which a segment ends with the document at hand.
SEGMENT = 1 << 18
#: Distinct parts that a worker remembers before it starts afresh (memory bound, no effect on results).
REMEMBERED = 700_000
#: Parts that are encoded as one string.
JOINED = 64
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


# ---------------------------------------------------------------- ids


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Parts(dict):
    """Numbers of distinct parts of chunks between ASCII white space, and the ids of all parts, end to end.

    A chunk that ends in ASCII marks after an ASCII letter or digit is parted there: the tokenizer's pattern always is.
    ASCII letters are lower-cased first, as the tokenizer does.  Neither is done where ``<|`` may begin a special token.
    A part of ASCII letters alone is one word to the tokenizer, so the tokenizer's model encodes it directly.
    """

    def __init__(self, tokenizer):
        super().__init__({b"": 0})
        self.tokenizer, self.new = tokenizer, []
        self.starts, self.flat = np.zeros(2, np.int64), np.empty(0, np.uint32)  # part 0 has no ids
        special = tokenizer.get_added_tokens_decoder()
        self.apart = next(((i, t.content) for i, t in special.items() if t.special and not t.normalized), None)

    def __missing__(self, part: bytes) -> int:
        self[part] = number = len(self)
        self.new.append(part)
        return number

    def numbers(self, chunks: pa.StringArray) -> np.ndarray:
        """The numbers of the two parts of each chunk (0: no such part)."""
        open_ = pc.match_substring(chunks, "<|")
        chunks = pc.if_else(open_, chunks, pc.ascii_lower(chunks))
        heads = pc.ascii_rtrim(chunks, MARKS)
        parted = pc.and_(pc.match_substring_regex(heads, "[A-Za-z0-9]$"), pc.invert(open_))
        heads = pc.if_else(parted, heads, chunks)
        out = np.zeros((len(chunks), 2), np.int64)
        distinct = heads.dictionary_encode()
        out[:, 0] = self._of(distinct.dictionary.cast(pa.binary()).to_pylist())[distinct.indices.to_numpy()]
        size = (pc.binary_length(chunks).to_numpy() - pc.binary_length(heads).to_numpy()).astype(np.int64)
        at = np.flatnonzero(size)
        whole = chunks.take(pa.array(at)).cast(pa.binary()).to_pylist()
        out[at, 1] = self._of([c[-n:] for c, n in zip(whole, size[at].tolist(), strict=True)])
        return out

    def _of(self, parts: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))

    def settle(self) -> None:
        """Encode the parts that are new."""
        if not self.new:
            return
        new, self.new = self.new, []
        model, ids, others = self.tokenizer.model, [], []
        for k, part in enumerate(new):
            if part.isalpha() and part.islower():  # of bytes: ASCII letters alone
                ids.append([t.id for t in model.tokenize(part.decode())])
            else:
                ids.append(None)
                others.append(k)
        for k, found in zip(others, self._whole([new[k].decode() for k in others]), strict=True):
            ids[k] = found
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])

    def _whole(self, parts: list[str]) -> Iterator[list[int]]:
        """The ids of each part by the whole tokenizer, many parts at a time with a special token between them."""
        step = JOINED if self.apart and not any("<|" in p for p in parts) else 1
        mark, text = self.apart or (None, "")
        groups = [text.join(parts[k : k + step]) for k in range(0, len(parts), step)]
        for k, found in enumerate(self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)):
            ids, number = found.ids, len(parts[k * step : (k + 1) * step])
            for _ in range(number - 1):
                at = ids.index(mark)
                yield ids[:at]
                ids = ids[at + 1 :]
            yield ids

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, by the numbers of their parts, end to end, and how many each has."""
        parts = numbers.ravel()
        start, size = self.starts[parts], self.starts[parts + 1] - self.starts[parts]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)
        return self.flat[at], size.reshape(-1, 2).sum(axis=1)


_PARTS: dict[str, Parts] = {}


def _parts(path: str) -> Parts:
    """What this worker remembers from its earlier batches, unless that is too much."""
    known = _PARTS.get(path)
    if known is None or len(known) > REMEMBERED:
        known = _PARTS[path] = Parts(_tokenizer(path))
    return known


def encoded(column: pa.Array, parts: Parts, end_id: int, dtype: str) -> pa.Array:
    """The ids of each text and ``end_id``, as binary values."""
    chunks = pc.ascii_split_whitespace(column.cast(pa.string()).fill_null(""))
    distinct = chunks.flatten().dictionary_encode()
    numbers = parts.numbers(distinct.dictionary)
    parts.settle()
    ids, sizes = parts.ids(numbers[distinct.indices.to_numpy()])
    edges = chunks.offsets.to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes)])[edges - edges[0]] + np.arange(len(edges))  # of the rows, from 0 on
    out = np.full(int(ends[-1]), end_id, dtype)
    own = np.ones(len(out), bool)
    own[ends[1:] - 1] = False  # the end id stands behind the ids of each row
    out[own] = ids
    offsets = pa.array(ends * out.itemsize, pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(column), [None, offsets.buffers()[1], pa.py_buffer(out)])


def tokenize(df: DataFrame, tokenizer_path: str, end_id: int, text: str = "text", out: str = "ids", dtype: str = "<u4",
             keep: list[str] | None = None) -> DataFrame:
    """``df`` with the ids of each text by the tokenizers library, without added special tokens, and ``end_id``, as
    little-endian unsigned integers (``dtype``: of 4 bytes, or 2 for ids below 65536) in column ``out``.

    For tokenizers that lower-case, and whose pattern drops white space and parts letters from marks (as that of the
    word vocabulary): then the ids of a text are those of its chunks between ASCII white space, and each distinct part
    of a chunk is encoded once.
    """

    def columns(batches):
        path = tokenizer_path if "/" in tokenizer_path else SparkFiles.get(tokenizer_path)
        for batch in batches:
            yield [encoded(batch.column(batch.schema.get_field_index(text)), _parts(path), end_id, dtype)]

    return with_arrow_columns(df, [text], [T.StructField(out, T.BinaryType())], columns, keep)


# ---------------------------------------------------------------- code


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths up to ``limit`` by package-merge, for positive counts."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes of more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        every = np.concatenate([weights, packages])
        rank = np.argsort(every, kind="stable")
        levels.append(rank < n)
        every = every[rank]
        packages = every[: len(every) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, need = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:need].sum())
        lengths[:leaves] += 1  # the lightest leaves are always taken first
        need = 2 * (need - leaves)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical codes of ``ids`` with lengths ``bits``."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort([ids, bits])
        self.ids, self.bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.width = int(self.bits.max()) if len(ids) else 1
        spans = np.left_shift(1, self.width - self.bits)  # of the table of all words of ``width`` bits
        starts = np.cumsum(spans) - spans
        size = int(self.ids.max()) + 1 if len(ids) else 0
        self.code_of, self.bits_of = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.code_of[self.ids] = starts >> (self.width - self.bits)
        self.bits_of[self.ids] = self.bits
        self._spans = spans
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The codes end to end, and the bit offset of every ``BLOCK``-th id."""
        bits, code = self.bits_of[ids], self.code_of[ids]
        ends = np.cumsum(bits)
        at = ends - bits
        word, room = at >> 5, 32 - (at & 31) - bits
        high = np.where(room >= 0, code << np.maximum(room, 0), code >> np.maximum(-room, 0))
        low = np.where(room < 0, (code << (32 + np.minimum(room, 0))) & 0xFFFFFFFF, 0)
        size = int(ends[-1] + 31 >> 5) + 1 if len(ids) else 0
        # the codes share no bit, so adding them (exactly: each word stays below 2**32) sets each of them
        words = np.bincount(word, high, size) + np.bincount(word + 1, low, size) if len(ids) else np.empty(0)
        return words.astype(np.int64).astype(">u4").tobytes(), at[::BLOCK].astype("<u4")

    def decode(self, payload: bytes, checkpoints: np.ndarray, size: int) -> np.ndarray:
        if not size:
            return np.empty(0, np.int64)
        if self._table is None:
            self._table = np.repeat(self.ids, self._spans), np.repeat(self.bits, self._spans)
        symbol, length = self._table
        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.int64)
        words = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at = checkpoints.astype(np.int64)
        out = np.zeros((len(at), BLOCK), np.int64)
        last = size - (len(at) - 1) * BLOCK  # ids of the last block
        for k in range(BLOCK):
            if k == last:
                at = at[:-1]
                if not len(at):
                    break
            window = ((words[at >> 3] << (at & 7)) & 0xFFFFFFFF) >> (32 - self.width)
            out[: len(at), k] = symbol[window]
            at = at + length[window]
        return out.reshape(-1)[:size]


# ---------------------------------------------------------------- files


def values(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in all binary values of a column end to end, and where each value ends."""
    column = column.cast(pa.binary()).fill_null(b"")
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2] or b""
    width = np.dtype(dtype).itemsize
    numbers = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]].view(dtype) if len(column) else np.empty(0, dtype)
    return numbers, (edges[1:] - edges[:1]) // width


def _counts(tokens: DataFrame, ids: str, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur and how often; as many rows as the vocabulary has ids at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            numbers = values(batch.column(0), dtype)[0]
            for at in range(0, len(numbers), SEGMENT):  # bincount copies what it counts to 8 bytes each
                found = np.bincount(numbers[at : at + SEGMENT])
                if len(found) < len(total):
                    found, total = total, found
                found[: len(total)] += total
                total = found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    rows = tokens.select(ids).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    rows.sort()
    return np.array([r.id for r in rows], np.int64), np.array([r.n for r in rows], np.int64)


def _code(book: list) -> Code:
    return Code(np.array([r[0] for r in book], np.int64), np.array([r[1] for r in book], np.int64))


SEGMENTS = ("file int, segment int, file_start long, doc_ids array<long>, doc_sizes array<int>, payload binary, "
            "checkpoints binary")


def write_tokens(tokens: DataFrame, path: str, ids: str = "ids", doc_id: str = "doc_id", dtype: str = "<u4") -> None:
    """Write the ids of ``tokens`` (little-endian, of type ``dtype``) as a file set, in ascending order of ``doc_id``."""
    spark = tokens.sparkSession
    tokens = staged(tokens.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")), "ids")
    book, n = _counts(tokens, "ids", dtype)
    book = list(zip(book.tolist(), code_lengths(n).tolist(), strict=True))
    spark.createDataFrame(book, "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, file, segment, start = _code(book), TaskContext.get().partitionId(), 0, 0
        docs, rows, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, rows, size, segment, start
            payload, checkpoints = code.encode(np.concatenate(rows).astype(np.int64))
            row = [[file], [segment], [start], [docs], [[len(r) for r in rows]], [payload], [checkpoints.tobytes()]]
            docs, rows, size, segment, start = [], [], 0, segment + 1, start + size
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            names = "file segment file_start doc_ids doc_sizes payload checkpoints".split()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            numbers, ends = values(batch.column(1), dtype)
            for d, x in zip(batch.column(0).to_pylist(), np.split(numbers, ends[:-1]) if len(ends) else [], strict=True):
                docs.append(d), rows.append(x)
                size += len(x)
                if size >= SEGMENT:
                    yield flush()
        if rows:
            yield flush()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # range bounds come from a sample of the keys, so these are short; the check sum deals out rows that share an id
    tokens = tokens.withColumn("tie", F.crc32("ids"))
    ordered = tokens.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids")
    ordered.select("doc_id", "ids").mapInArrow(run, SEGMENTS).write.parquet(f"{path}/segments")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a file set: doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit
    integers)."""
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    # one row per written file, at most as many as the shuffle partitions of the writer: the ids of the files before it
    sizes = F.aggregate("doc_sizes", F.lit(0).cast("long"), lambda total, x: total + x)
    files = segments.groupBy("file").agg(F.sum(sizes).alias("n"))
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = F.broadcast(files.select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before")))
    book = [tuple(r) for r in spark.read.schema("id int, bits int").parquet(f"{path}/codebook").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _code(book)
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.array(r["doc_sizes"], np.int64)
                ends = np.cumsum(sizes)
                ids = code.decode(r["payload"], np.frombuffer(r["checkpoints"], "<u4"), int(ends[-1])).astype("<u4")
                each = [ids[b - a : b].tobytes() for a, b in zip(sizes, ends, strict=True)]
                starts = r["before"] + r["file_start"] + ends - sizes
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts), pa.array(each, pa.binary())],
                                                 names=["doc_id", "start", "ids"])

    return segments.join(files, "file").mapInArrow(run, "doc_id long, start long, ids binary")


def scratch_path(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
