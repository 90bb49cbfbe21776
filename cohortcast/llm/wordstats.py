"""Numbers per distinct word, and bounded samples of labelled documents."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Distinct words that a worker remembers before it starts afresh (memory bound, no effect on results).
REMEMBERED = 200_000


class WordTable(dict):
    """A row of numbers for each distinct word, computed once."""

    def __init__(self, describe: Callable[[str], tuple[float, ...]]):
        super().__init__()
        self.describe, self.rows, self.table = describe, [], None

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.rows.append(self.describe(word))
        return number

    def numbers(self, words: list[str]) -> np.ndarray:
        """The rows of ``words``, by number."""
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def settle(self) -> np.ndarray:
        """The rows of all numbers so far."""
        if self.rows:
            new = np.array(self.rows, np.float32)
            self.table = new if self.table is None else np.concatenate([self.table, new])
            self.rows = []
        return self.table

    def shrink(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()
            self.rows, self.table = [], None


def letters(word: str) -> tuple[int, int, int, int, int]:
    """Upper-case letters, letters, digits, punctuation and symbols, all characters."""
    if word.isascii() and word.isalpha():
        upper = 0 if word.islower() else sum(map(str.isupper, word))
        return upper, len(word), 0, 0, len(word)
    upper = alpha = digit = mark = 0
    for c in word:
        if c.isalpha():
            alpha += 1
            upper += c.isupper()
        elif c.isdigit():
            digit += 1
        elif unicodedata.category(c)[0] in "PS":
            mark += 1
    return upper, alpha, digit, mark, len(word)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, size: int, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Texts of at most ``size`` labelled ids for which ``learn`` holds: doc_id, text, y (0 or 1) and u (a number from 0
    to 999 by which to split the sample).  The ids are the first by a hash; an id with several labels has the largest."""
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & learn)
    known = known.groupBy(doc_id).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.withColumn("order", F.xxhash64(F.col(doc_id))).orderBy("order", doc_id).limit(size)
    known = known.select(F.col(doc_id).alias("doc_id"), "y", F.pmod("order", F.lit(1000)).cast("int").alias("u"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return staged(texts.join(F.broadcast(known), "doc_id"), "labelled")  # at most ``size`` ids
