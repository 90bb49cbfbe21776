"""Byte-level BPE encoding and decoding by the ranks of a vocabulary file.

A text is cut by a pattern into pieces; every distinct piece of a partition is encoded once.  Pieces of similar byte
length form one padded matrix of token ids.  In each round every row merges its leftmost pair of least rank; the pair
ranks stand in a second matrix of which only the neighbours of a merge are looked up again, in an open-addressing
hash table of pairs.  Finished rows leave the matrix and its width shrinks with the longest row left.

Pieces over ``WIDEST`` bytes would take one round per merge in a very wide row.  They go one by one and merge, in one
round, all occurrences of the least-ranked pair up to the first merge that makes a pair of lower rank; this is the
same sequence of merges.

Nulls encode as the empty text, whose ids are empty.  Repeated rows and ties in ids are rows like any other; input
columns named like an output are replaced.  Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import texts, with_arrow_columns

NO_PAIR = np.int64(1) << 62
WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64, 128, 256)
WIDEST = WIDTHS[-1]
#: Distinct pieces that a worker remembers before it starts afresh (memory bound, no effect on results).
REMEMBERED = 150_000
#: Texts over this many characters are cut into pieces a stretch at a time (memory bound, no effect on results).
STRETCH = 2_000_000


class PairTable:
    """Merged id of a pair of ids, by multiplicative hashing with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(len(left) * 2.5).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NO_PAIR, np.int64)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            at, first = np.unique(slot[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[at], self.values[at] = keys[placed], merged[placed]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids; ``NO_PAIR`` where the pair has none or either side is padding (negative)."""
        shape = left.shape
        keys = ((left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)).ravel()
        out = np.full(keys.shape, NO_PAIR, np.int64)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(keys[todo])
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there != -1)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out.reshape(shape)


class Ranks:
    """The merges of one rank file (lines of base64 token and rank)."""

    def __init__(self, lines: Iterator[bytes]):
        rank = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        left, right, merged = [], [], []
        for token, r in rank.items():
            for i in range(1, len(token)):
                a, b = rank.get(token[:i]), rank.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(r)
        self.pairs = PairTable(*(np.array(x, np.int64) for x in (left, right, merged)))
        self.byte_ids = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        self.tokens = [b""] * (max(rank.values()) + 1)
        for token, r in rank.items():
            self.tokens[r] = token

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            for part in np.array_split(rows, max(1, -(-len(rows) * width // 2_000_000))):
                if len(part):
                    self._merge_matrix(pieces, part, lengths[part], width, out)
            low = width
        for i in np.flatnonzero(lengths > WIDEST):
            out[i] = self._merge_long(self.byte_ids[np.frombuffer(pieces[i], np.uint8)])
        return out

    def _merge_matrix(self, pieces, rows, lengths, width, out) -> None:
        ids = np.full((len(rows), width), -1, np.int64)
        ids[np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)]
        lengths = lengths.copy()
        ranks = np.full((len(rows), width), NO_PAIR, np.int64)
        ranks[:, :-1] = self.pairs(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            best = ranks[every, at]
            done = best == NO_PAIR
            if done.any():
                for k in np.flatnonzero(done):
                    out[rows[k]] = ids[k, : lengths[k]].copy()
                left = ~done
                if not left.any():
                    return
                rows, lengths, at, best = rows[left], lengths[left], at[left], best[left]
                width = int(lengths.max())
                ids, ranks = ids[left, :width], ranks[left, :width]
                every = np.arange(len(rows))
            # close the gap after the merged pair, in ids and in ranks
            columns = np.arange(width - 1)
            take = columns + (columns > at[:, None])
            ids[every, at] = best
            ids = np.concatenate([np.take_along_axis(ids, take, 1), np.full((len(rows), 1), -1, np.int64)], axis=1)
            ranks = np.concatenate([np.take_along_axis(ranks, take, 1), np.full((len(rows), 1), NO_PAIR, np.int64)], axis=1)
            lengths -= 1
            before = at > 0
            ranks[every[before], at[before] - 1] = self.pairs(ids[every[before], at[before] - 1], best[before])
            after = np.where(at + 1 < width, ids[every, np.minimum(at + 1, width - 1)], -1)
            ranks[every, at] = self.pairs(best, after)

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        while len(ids) > 1:
            ranks = self.pairs(ids[:-1], ids[1:])
            least = ranks.min()
            if least == NO_PAIR:
                break
            at = np.flatnonzero(ranks == least)
            # of overlapping occurrences (runs of one id) every other one, from the left
            run = np.r_[True, np.diff(at) != 1]
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            joined = np.r_[False, at[1:] == at[:-1] + 2]
            before = np.where(joined, least, np.where(at > 0, ids[np.maximum(at - 1, 0)], -1))
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            same = np.full(len(at), least)
            lower = (self.pairs(before, same) < least) | (self.pairs(same, after) < least)
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            ids = ids.copy()
            ids[at] = least
            ids = np.delete(ids, at + 1)
        return ids


@lru_cache(maxsize=4)
def ranks_at(path: str) -> Ranks:
    with open(path, "rb") as lines:
        return Ranks(lines)


class Pieces(dict):
    """Number of each distinct piece; ids of all pieces, end to end."""

    def __init__(self, ranks: Ranks):
        super().__init__()
        self.ranks, self.new = ranks, []
        self.starts, self.flat = np.zeros(1, np.int64), np.empty(0, np.int64)

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number

    def settle(self) -> None:
        """Encode the pieces that are new."""
        if self.new:
            ids = self.ranks.encode_pieces([p.encode() for p in self.new])
            ends = self.starts[-1] + np.cumsum([len(x) for x in ids])
            self.starts = np.concatenate([self.starts, ends])
            self.flat = np.concatenate([self.flat, *ids])
            self.new = []

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of a row of pieces."""
        start, size = self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers]
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]


def _numbers(pattern, pieces: Pieces, text: str) -> np.ndarray:
    if len(text) <= STRETCH:
        found = pattern.findall(text)
        return np.fromiter(map(pieces.__getitem__, found), np.int64, len(found))
    parts, matches = [], (m.group() for m in pattern.finditer(text))
    while found := list(islice(matches, 200_000)):
        parts.append(np.fromiter(map(pieces.__getitem__, found), np.int64, len(found)))
    return np.concatenate(parts)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids",
           layout: str = "binary", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the ids of each text in column ``out``.

    ``layout``: ``binary`` (ids as little-endian unsigned 32-bit integers) or ``array`` (array<int>).
    ``ranks_path`` is a file that every machine has (or one added with ``addFile``, by its bare name).
    ``pattern`` is in the syntax of the regex library; what it doesn't match is dropped.
    """

    def columns(batches):
        path = ranks_path if "/" in ranks_path else SparkFiles.get(ranks_path)
        cut, pieces = regex.compile(pattern), Pieces(ranks_at(path))
        for batch in batches:
            rows = [_numbers(cut, pieces, t.decode()) for t in texts(batch, text)]
            pieces.settle()
            ids = (pieces.ids(r).astype("<u4") for r in rows)
            if layout == "array":
                yield [pa.array((x.astype(np.int32) for x in ids), pa.list_(pa.int32()), size=len(rows))]
            else:
                yield [pa.array((x.tobytes() for x in ids), pa.binary(), size=len(rows))]
            if len(pieces) > REMEMBERED:
                pieces = Pieces(pieces.ranks)

    kind = T.ArrayType(T.IntegerType()) if layout == "array" else T.BinaryType()
    return with_arrow_columns(df, [text], [T.StructField(out, kind)], columns, keep)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded",
           keep: list[str] | None = None) -> DataFrame:
    """``df`` with the bytes of the ids in ``ids`` (either layout of :func:`encode`; null: empty) in column ``out``.
    An id that the vocabulary lacks raises ``IndexError``."""

    def columns(batches):
        tokens = ranks_at(ranks_path if "/" in ranks_path else SparkFiles.get(ranks_path)).tokens
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            rows = (np.frombuffer(x, "<u4").tolist() if isinstance(x, bytes) else x or [] for x in column.to_pylist())
            yield [pa.array((b"".join(map(tokens.__getitem__, r)) for r in rows), pa.binary(), size=len(column))]

    return with_arrow_columns(df, [ids], [T.StructField(out, T.BinaryType())], columns, keep)
