"""Line deduplication: lines that many documents share stay in one document only.  SQL functions throughout.

A text is split at ``\\n``; a null or empty text is one empty line.  A line's key is the line without the white space
(``[\\x20\\x09-\\x0D]``) at both ends, with A-Z lower-cased.  Lines are exploded with their positions and the 128-bit hash
of their key; keys of at least ``MIN_CHARS`` code points that at least ``MIN_DOCS`` distinct ids hold lose their lines,
except in the largest id that holds the key, where all of them stay.  The other lines are put together by position.

Ids and hashes of long lines move once for the count: distinct (hash, id) pairs are counted in two steps, so a line that a
third of all documents holds is spread by its ids and comes to a hash's task as one partial count per task.  The table of
common lines is broadcast within ``BROADCAST_ROWS``, else joined by a shuffle that Spark may split.  Positions to drop
meet the lines of their row under a hash of its id and text, so rows that repeat an id with another text are judged
apart and copies of a row share one entry.  No task holds more than the lines of one text.

A null id counts as one document, smaller than all others.  A null text stays null.  Empty tables give empty results.
Columns of the input are carried on, and those named ``n_lines`` or ``n_dropped`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.small import small_side
from .common import ascii_lower, staged

MIN_CHARS = 40
MIN_DOCS = 5
#: Tables of common lines (three numbers a row) up to this are broadcast.
BROADCAST_ROWS = 500_000

SPACE = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def hashes(*values: Column) -> list[Column]:
    """Two 64-bit hashes of the same values."""
    return [F.xxhash64(*values), F.xxhash64(F.lit(1), *values)]


def long_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(id, row_1, row_2, position, key_1, key_2) of each line whose key has enough characters."""
    one, two = hashes(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.col(doc_id).isNull(), F.col(text))
    rows = docs.select(F.col(doc_id).alias("id"), one.alias("row_1"), two.alias("row_2"), F.col(text).alias("text"))  # hashed once a row
    rows = rows.select("id", "row_1", "row_2", F.posexplode(lines_of(F.col("text"))).alias("position", "line"))
    rows = rows.select("id", "row_1", "row_2", "position", F.btrim("line", F.lit(SPACE)).alias("line")).filter(F.char_length("line") >= min_chars)
    one, two = hashes(ascii_lower(F.col("line")))
    return rows.select("id", "row_1", "row_2", "position", one.alias("key_1"), two.alias("key_2"))


def common_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(key_1, key_2, last): keys that enough ids hold, and the largest of these."""
    pairs = lines.select("key_1", "key_2", "id").distinct()
    counted = pairs.groupBy("key_1", "key_2").agg(F.count(F.lit(1)).alias("ids"), F.max("id").alias("last"))
    return counted.filter(F.col("ids") >= min_docs).select("key_1", "key_2", "last")


def drop_common_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                      min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the lines that stay in ``text``, n_lines (before) and n_dropped."""
    lines = long_lines(docs, doc_id, text, min_chars)
    common = small_side(staged(common_lines(lines, min_docs), "common-lines"), BROADCAST_ROWS)
    found = lines.join(common, ["key_1", "key_2"]).filter(~F.col("id").eqNullSafe(F.col("last")))
    found = found.groupBy("row_1", "row_2").agg(F.collect_set("position").alias("drop"))
    one, two = hashes(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.col(doc_id).isNull(), F.col(text))
    others = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    rows = docs.select(F.struct(*others).alias("own"), F.col(text).isNull().alias("none"), lines_of(F.col(text)).alias("lines"),
                       one.alias("row_1"), two.alias("row_2"))
    rows = rows.join(found.hint("shuffle_hash"), ["row_1", "row_2"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))  # in order, by a hash set
    kept = F.when(F.col("drop").isNull(), F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform(stay, lambda k: F.get("lines", k)), "\n"))
    values = {c: F.col("own")[c] for c in others} | {text: F.when(~F.col("none"), kept)}
    return rows.select(*[values[c].alias(c) for c in docs.columns if c in values], F.size("lines").cast("long").alias("n_lines"),
                       F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))
