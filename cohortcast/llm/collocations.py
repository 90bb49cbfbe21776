"""Phrase collocations by a weighted de Bruijn graph.

Texts are cut at punctuation and line ends into pieces and these into words (A-Z lower-cased).  Nodes of the graph are
phrases of ``longest`` - 1 words, and an edge is a phrase of ``longest`` words, from its first words to its last, weighted
by its occurrences.  Tasks sum the edges of their rows in arrays of word numbers, and Spark sums them by node.  Where a
piece ends, no edge begins: there the piece's last words are counted as shorter rows.  These end corrections and the
edges that leave a node sum to its flow, which is the count of its phrase; the flows of nodes with the same beginning and
the ends sum likewise to the counts of shorter phrases, down to words and to the number of words of a language.

A node that all its occurrences enter by one edge and leave by one edge is unary: both edges then have its count.
Unary nodes are compacted: edges that meet in them become one path, found by doubling pointers to the path's first edge.
All edges of a path weigh the same, and a path is never longer than its piece.  Only phrases of ``least`` occurrences or
more can be reported, so paths are made of edges of that weight (which takes whole paths, as their weight is one).
A path's inner nodes lie inside a longer phrase of the same count; only nodes where paths begin and end are compared.

A null language counts as ``und``, a null text as empty.  Repeated rows count as often as they occur.  Ties of scores go
to the higher count, then to the phrase's bytes.  A task holds ``BATCH`` words at a time and takes long texts in
parts; empty tables give empty results; columns other than the text and the language are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

LONGEST = 3
LEAST = 10
#: A phrase goes if a longer one with this share (percent) of its count holds it.
ABSORB = 50
TOP = 2000

#: Words that a task holds before it passes their sums on, and bytes of a text that it cuts at once.
BATCH = 1 << 21
PART = 1 << 20
#: Rows of a batch that a task passes on.
ROWS = 1 << 16

#: The fixed separators of pieces become line ends, A-Z lower case, and tabs spaces.
TABLE = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A line end stands for the end of a piece, a space parts words: numbers of "\n" and "" in every vocabulary.
END, NOTHING = 0, 1


class Words(dict):
    """Numbers of words in the order of their first occurrence."""

    def __init__(self) -> None:
        super().__init__({b"\n": END, b"": NOTHING})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def parts(text: bytes) -> Iterator[bytes]:
    """``text`` in parts that end where a word does."""
    at = 0
    while len(text) - at > PART:
        cut = at + PART
        while cut < len(text) and text[cut] not in b" \n":
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


class Grams:
    """Sums of the phrases of one language that begin at each word."""

    def __init__(self, longest: int) -> None:
        self.longest, self.words, self.numbers, self.held = longest, Words(), [], 0

    def parts(self, text: bytes) -> Iterator[None]:
        """Takes ``text`` part by part and stops after each."""
        ends = b" \n" * (self.longest - 1) + b" "
        for part in parts(text.translate(TABLE)):
            tokens = part.replace(b"\n", ends).split(b" ")
            self.take(np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens)))
            yield
        self.take(np.full(self.longest - 1, END))

    def take(self, numbers: np.ndarray) -> None:
        numbers = numbers[numbers != NOTHING]
        self.numbers.append(numbers)
        self.held += len(numbers)

    def sums(self, last: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct phrases (rows of word numbers, ``END`` beyond a piece's end) and their counts; what is held goes, but
        for the words that phrases yet to come may begin with."""
        held = np.concatenate(self.numbers) if self.numbers else np.zeros(0, np.int64)
        n = len(held) - self.longest + 1
        starts = np.arange(max(n, 0))[held[: max(n, 0)] != END]
        self.numbers, self.held = ([], 0) if last else ([held[max(n, 0):]], len(held) - max(n, 0))
        if not len(starts):
            return None
        width = max(1, int(len(self.words) - 1).bit_length())
        per = 63 // width  # words in one number
        found = np.stack([held[starts + k] for k in range(self.longest)], axis=1)
        for k in range(1, self.longest):  # nothing of the next piece
            found[found[:, k - 1] == END, k] = END
        packed = [sum(found[:, k] << (width * (min(at + per, self.longest) - 1 - k)) for k in range(at, min(at + per, self.longest)))
                  for at in range(0, self.longest, per)]
        order = np.lexsort(packed[::-1]) if len(packed) > 1 else np.argsort(packed[0])
        new = np.ones(len(order), bool)
        new[1:] = np.any([p[order][1:] != p[order][:-1] for p in packed], axis=0)
        first = np.flatnonzero(new)
        return found[order[first]], np.diff(np.append(first, len(order)))


def _joined(words: pa.Array, numbers: np.ndarray) -> pa.Array:
    """The words of each row, space-joined up to the first ``END``."""
    import pyarrow.compute as pc

    text = words.take(pa.array(numbers[:, 0]))
    for k in range(1, numbers.shape[1]):
        more = numbers[:, k] != END
        if not more.any():
            break
        longer = pc.binary_join_element_wise(text, words.take(pa.array(numbers[:, k])), pa.scalar(" "))
        text = longer if more.all() else pc.if_else(pa.array(more), longer, text)
    return text


def grams(docs: DataFrame, text: str, lang: Column, longest: int) -> DataFrame:
    """(lang, node, next, count): for each task and batch the sums of what begins at its words; ``next`` is null where a
    piece ends within ``longest`` words, and ``node`` then all that is left of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, Grams] = {}

        def passed(name: str, last: bool) -> Iterator[pa.RecordBatch]:
            if (found := state[name].sums(last)) is None:
                return
            words = pa.array(list(state[name].words), pa.binary()).cast(pa.string())
            for at in range(0, len(found[1]), ROWS):
                rows, sums = found[0][at : at + ROWS], found[1][at : at + ROWS]
                tail = pa.array(rows[:, -1], mask=rows[:, -1] == END)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), _joined(words, rows[:, :-1]), words.take(tail),
                                                  pa.array(sums, pa.int64())], names=["lang", "node", "next", "count"])

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                g = state.setdefault(name, Grams(longest))
                for _ in g.parts(value.as_py()):
                    if g.held > BATCH:
                        yield from passed(name, last=False)
                if sum(g.held for g in state.values()) > BATCH:
                    for name in state:
                        yield from passed(name, last=True)
                    state.clear()
        for name in state:
            yield from passed(name, last=True)

    rows = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, node string, next string, count long")


def first_words(phrase: str, k: int) -> Column:
    return F.substring_index(phrase, " ", k)


def size_of(phrase: str) -> Column:
    """Number of words."""
    return F.char_length(phrase) - F.char_length(F.replace(F.col(phrase), F.lit(" "))) + 1


def counts(docs: DataFrame, text: str, lang: Column, longest: int, least: int) -> DataFrame:
    """(lang, level, phrase, count): sums of ``least`` or more of the edges (level ``longest``), of the nodes' flows and of
    what begins with fewer words; under level 0 the number of all words of each language.  A phrase of fewer words than
    its level is what pieces end with.

    All levels read one shuffle by node: filters that could be moved before it are left to the reader (``phrases_of``)."""
    nodes = grams(docs, text, lang, longest).repartition("lang", "node")
    sums = nodes.groupBy("lang", "node", "next").agg(F.sum("count").alias("count"))
    levels = [sums.select("lang", F.lit(longest).alias("level"), F.concat_ws(" ", "node", "next").alias("phrase"), "count")]
    goes_on, ends = (F.coalesce(F.sum(F.when(x, F.col("count"))), F.lit(0)) for x in (F.col("next").isNotNull(), F.col("next").isNull()))
    flow = nodes.groupBy("lang", F.col("node").alias("phrase")).agg((goes_on + ends).alias("count"))
    for size in range(longest - 1, 0, -1):
        if size < longest - 1:
            flow = flow.groupBy("lang", first_words("phrase", size).alias("phrase")).agg(F.sum("count").alias("count"))
        levels.append(flow.select("lang", F.lit(size).alias("level"), "phrase", "count"))
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    total = flow.groupBy("lang").agg(F.sum("count").alias("count")).select("lang", F.lit(0).alias("level"), F.lit("").alias("phrase"), "count")
    return every.filter(F.col("count") >= least).unionByName(total)


def phrases_of(known: DataFrame, size: int) -> DataFrame:
    """(lang, phrase, count) of the phrases of ``size`` words in ``counts``."""
    return known.filter((F.col("level") == size) & (size_of("phrase") == size)).select("lang", "phrase", "count")


def compact(edges: DataFrame, flows: DataFrame, longest: int) -> DataFrame:
    """(lang, words, count): the paths that ``edges`` (lang, phrase, count) form through unary nodes, of ``flows`` (lang,
    phrase, count); each edge lies on one path.  Rounds double what a pointer spans."""
    node = F.col("count").alias("flow")
    ends = edges.select("lang", "phrase", "count", first_words("phrase", longest - 1).alias("tail"),
                        F.substring_index("phrase", " ", -(longest - 1)).alias("head"))
    into = ends.join(flows.select("lang", F.col("phrase").alias("head"), node), ["lang", "head"]).filter(F.col("count") == F.col("flow"))
    out = ends.join(flows.select("lang", F.col("phrase").alias("tail"), node), ["lang", "tail"]).filter(F.col("count") == F.col("flow"))
    before = into.select("lang", F.col("head").alias("tail"), F.col("phrase").alias("first")).join(
        out.select("lang", "tail", "phrase"), ["lang", "tail"])
    links = ends.join(before.select("lang", "phrase", "first"), ["lang", "phrase"], "left")
    known = F.col("first").isNull()
    ranks = staged(links.select("lang", "phrase", "count", F.coalesce("first", "phrase").alias("first"),
                                F.when(known, 0).otherwise(1).cast("long").alias("steps"), known.alias("done")), "links")
    while ranks.filter(~F.col("done")).limit(1).count():
        ahead = ranks.select("lang", F.col("phrase").alias("first"), F.col("first").alias("further"), F.col("steps").alias("more"), F.col("done").alias("there"))
        open_ = ranks.filter(~F.col("done")).join(ahead, ["lang", "first"]).select(
            "lang", "phrase", "count", F.col("further").alias("first"), (F.col("steps") + F.col("more")).alias("steps"), F.col("there").alias("done"))
        ranks = staged(ranks.filter("done").unionByName(open_), "ranks")
    word = F.element_at(F.split("phrase", " "), -1)
    along = F.array_sort(F.collect_list(F.when(F.col("steps") > 0, F.struct("steps", word.alias("word")))))
    paths = ranks.groupBy("lang", "first").agg(F.max("count").alias("count"), along.alias("along"))
    return paths.select("lang", F.concat(F.split("first", " "), F.transform("along", lambda s: s["word"])).alias("words"), "count")


def edges_of(paths: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, count, inner): the edges of each path; ``inner`` if the node it leads to is inside the path."""
    last = F.size("words") - longest
    at = F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(
        F.array_join(F.slice("words", k + 1, longest), " ").alias("phrase"), (k < last).alias("inner")))).alias("e")
    return paths.select("lang", "count", at).select("lang", F.col("e.phrase").alias("phrase"), "count", F.col("e.inner").alias("inner"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST,
                 absorb: int = ABSORB) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score) of all phrases of 2 to ``longest`` words that aren't part of a longer one.

    ``a`` counts the phrase; a cut after its first words has the counts ``l`` and ``r`` of both parts and the score
    floor(1000000 a a / (l r)); the least score counts, and of equal ones the first cut.  Exact up to a count of 10^15."""
    if longest < 2:
        raise ValueError("phrases have two words at least")
    known = staged(counts(docs, text, F.col(lang).cast("string"), longest, least), "phrase-counts")
    at = lambda size: phrases_of(known, size)
    paths = staged(compact(at(longest), at(longest - 1), longest), "paths")
    edges = edges_of(paths, longest)
    kept = [edges.select("lang", "phrase", "count")]
    above, inner = kept[0], edges.filter("inner")
    for size in range(longest - 1, 1, -1):
        here = at(size)
        if size == longest - 1:  # inside a path nothing is left to compare
            here = here.join(inner.select("lang", F.substring_index("phrase", " ", -size).alias("phrase")), ["lang", "phrase"], "left_anti")
        holds = (above.select("lang", first_words("phrase", size).alias("phrase"), F.col("count").alias("longer"))
                 .unionByName(above.select("lang", F.substring_index("phrase", " ", -size).alias("phrase"), F.col("count").alias("longer"))))
        holds = holds.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        here = here.join(holds, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < absorb * F.col("count"), F.lit(True)))
        kept.append(here.select("lang", "phrase", "count"))
        above = at(size)
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    words = size_of("phrase")
    cuts = every.select("lang", "phrase", F.col("count").alias("a"), words.alias("size"), F.explode(F.sequence(F.lit(1), words - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', k)").alias("left_part"), F.expr("substring_index(phrase, ' ', k - size)").alias("right_part"))
    parts_ = known.filter((F.col("level") > 0) & (size_of("phrase") == F.col("level"))).select("lang", "phrase", "count")
    cuts = cuts.join(parts_.select("lang", F.col("phrase").alias("left_part"), F.col("count").alias("l")), ["lang", "left_part"])
    cuts = cuts.join(parts_.select("lang", F.col("phrase").alias("right_part"), F.col("count").alias("r")), ["lang", "right_part"])
    big = lambda c: F.col(c).cast("decimal(16,0)")
    cuts = cuts.withColumns({"up": big("a") * big("a") * F.lit(1000000).cast("decimal(7,0)"), "down": big("l") * big("r")})
    best = cuts.withColumn("score", F.expr("up div down")).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    total = known.filter("level = 0").select("lang", F.col("count").alias("n"))
    return best.join(total, "lang").select("lang", "phrase", "size", "a", "b.l", "b.r", "n", F.col("b.score").alias("score"))


def report(found: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases by score, count and phrase.

    Ranks are taken among the best of each of several parts of a language first, so that no task sorts all of one."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    best = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    best = best.filter(F.col("rank") <= top).drop("rank")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
