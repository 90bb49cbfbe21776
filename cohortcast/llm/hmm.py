"""Hidden Markov language model.

Tokens are the words between ASCII white space, with A-Z lower-cased, and one end per text.  A state emits a word class
(one of ``CLASSES``, by crc32 of the word; the end is a class of its own), and the class emits the word by its count in
the training texts: (c + 1) / (N_class + V_class + 1), which leaves one share to words unseen.  The states' model has a
fixed size; the word counts grow with the corpus and stay in a table.

1. ``index``: every partition turns its texts into blocks of about ``BLOCK`` tokens with a vocabulary of their own, so
   that later steps move one row per block and word instead of one per token, and no step splits a text again.
2. Word counts: the blocks' counts, summed per word by a shuffle.
3. ``train``: Baum-Welch.  Each round runs forward and backward over all training tokens (in passages of ``PASSAGE``
   tokens; one that continues a text has a start distribution of its own), sums the expected counts per partition and
   then over partitions, and updates the model on the driver (CLASSES x STATES numbers).
4. ``score``: the scaled forward recursion over whole texts.  Texts of more than ``RUN`` tokens are cut into runs
   whose transfer matrices are computed side by side and multiplied in order, which is the same recursion.

Null texts count as empty (one end token).  A null id is in the fold of the empty string.  Repeated rows and ids are
scored one by one.  Without training texts the model is uniform.  Columns besides id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, texts

STATES = 8
CLASSES = 8192
ROUNDS = 8
BLOCK = 1 << 20
PASSAGE = 128
#: Tokens of the runs into which the scoring cuts longer texts.
RUN = 4096
#: Weight, in tokens, of the corpus-wide class distribution in that of a state.
PRIOR = 2000.0


@dataclass
class Corpus:
    """``blocks``: texts as word numbers; ``words``: word, class, count (above 0) in training texts, and how many
    blocks have it."""

    blocks: DataFrame
    words: DataFrame
    classes: int
    tokens: int  # N
    distinct: int  # V
    class_tokens: np.ndarray
    class_words: np.ndarray


@dataclass
class Model:
    start: np.ndarray  # of texts and of passages that continue one: (2, states)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes + 1, states): probability of a class in each state


# ---------------------------------------------------------------- index


def index(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", classes: int = CLASSES) -> Corpus:
    """Blocks of all texts; counts of those where ``held_out`` is false."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)),
        T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("codes", T.BinaryType()), T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("word_class", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        id_kind = None

        def fresh():
            return defaultdict(count().__next__), [], [], [], 0

        def block(vocabulary, ids, held, codes) -> pa.RecordBatch:
            nonlocal number
            size = len(vocabulary)
            train = [c for c, h in zip(codes, held, strict=True) if not h]
            counts = np.bincount(np.concatenate(train), minlength=size) if train else np.zeros(size, np.int64)
            word_class = np.fromiter((zlib.crc32(w) % classes for w in vocabulary), np.uint32, size)
            row = [[number], [ids], [held], [[len(c) for c in codes]], [_packed(np.concatenate(codes))], [[w.decode() for w in vocabulary]],
                   [counts.tolist()], [word_class.astype("<u4").tobytes()]]
            kinds = [pa.int64(), pa.list_(id_kind), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(),
                     pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=schema.names)

        vocabulary, ids, held, codes, size = fresh()
        for batch in batches:
            id_kind = batch.schema.field(0).type
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch, "t"), strict=True):
                found = t.lower().split()
                ids.append(i), held.append(h)
                codes.append(np.fromiter(map(vocabulary.__getitem__, found), np.int64, len(found)))
                size += len(found)
                if size >= BLOCK:
                    yield block(vocabulary, ids, held, codes)
                    vocabulary, ids, held, codes, size = fresh()
        if ids:
            yield block(vocabulary, ids, held, codes)

    source = docs.select(F.col(doc_id), held_out.alias("held"), F.col(text).alias("t"))
    blocks = staged(source.mapInArrow(run, schema), "blocks")
    pairs = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("p")).select("p.words", "p.counts")
    words = pairs.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("c"), F.count(F.lit(1)).alias("in_blocks"))
    words = words.filter("c > 0")
    words = staged(words.withColumn("class", (F.crc32(F.col("word").cast("binary")) % classes).cast("int")), "words")
    tokens, distinct = np.zeros(classes), np.zeros(classes)
    for r in words.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # one row a class
        tokens[r["class"]], distinct[r["class"]] = r.n, r.v
    ends = blocks.select(F.expr("aggregate(held, 0L, (n, h) -> n + if(h, 0L, 1L))").alias("n")).agg(F.sum("n")).first()[0] or 0
    return Corpus(blocks, words, classes, int(tokens.sum()) + ends, int(distinct.sum()) + (ends > 0),
                  np.append(tokens, ends), np.append(distinct, float(ends > 0)))


def _packed(codes: np.ndarray) -> bytes:
    """Numbers below 2**32, byte by byte of all of them: the upper bytes hold little and pack well."""
    return zstandard.ZstdCompressor(level=1).compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _class_runs(row: dict, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: the word numbers, end to end; the classes of all tokens, an end after each text; the sizes with ends."""
    word_class = np.frombuffer(row["word_class"], "<u4").astype(np.int64)
    codes = _unpacked(row["codes"])
    sizes = np.array(row["sizes"], np.int64)
    tokens = np.insert(word_class[codes] if len(codes) else np.empty(0, np.int64), np.cumsum(sizes), classes)
    return codes, tokens, sizes + 1


# ---------------------------------------------------------------- Baum-Welch


def _first_model(corpus: Corpus, states: int, seed: int) -> Model:
    """The corpus's class distribution, tilted at random for each state; states that mostly stay."""
    rng = np.random.default_rng(seed)
    share = (corpus.class_tokens + 1) / (corpus.class_tokens.sum() + corpus.classes + 1)
    emit = share[:, None] * rng.gamma(2.0, size=(corpus.classes + 1, states))
    emit[-1] = share[-1]
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full((2, states), 1 / states), move, emit / emit.sum(axis=0))


def _runs(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts, end to end, cut into runs of at most ``limit`` tokens: first token, size, text, and whether it continues one."""
    pieces = -(-sizes // limit)
    text = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(np.cumsum(sizes) - sizes, pieces) + nth * limit
    return first, np.minimum(limit, sizes[text] - nth * limit), text, (nth > 0).astype(np.int64)


def _expected(model: Model, tokens: np.ndarray, first: np.ndarray, size: np.ndarray, kind: np.ndarray,
              starts: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> float:
    """Add the expected counts of some runs; their log-likelihood.  Arrays are (time, state, run), longest run first, so
    that each step works on whole rows; what lies behind the end of a run stays 0."""
    order = np.argsort(-size, kind="stable")
    first, size, kind = first[order], size[order], kind[order]
    length, states = int(size[0]), model.move.shape[0]
    at = np.minimum(first + np.arange(length)[:, None], len(tokens) - 1)
    symbol = tokens[at]
    active = (size > np.arange(length)[:, None]).sum(axis=1)
    emit = model.emit.T  # (states, classes + 1), rows contiguous
    emission = [np.take(emit, symbol[t, : active[t]], axis=1) for t in range(length)]
    alpha = np.zeros((length, states, len(size)))
    scale = np.ones((length, len(size)))
    back = np.ascontiguousarray(model.move.T)
    for t in range(length):
        n = active[t]
        a = (model.start[kind].T if t == 0 else back @ alpha[t - 1, :, :n]) * emission[t]
        s = a.sum(axis=0)
        scale[t, :n] = s
        np.divide(a, s, out=alpha[t, :, :n])
    beta = np.ones((states, len(size)))
    for t in range(length - 1, -1, -1):
        n = active[t]
        if t:
            ahead = emission[t] * beta[:, :n]
            ahead /= scale[t, :n]
            moves += alpha[t - 1, :, :n] @ ahead.T
        alpha[t, :, :n] *= beta[:, :n]
        if t:
            beta[:, :n] = model.move @ ahead
    for k in (0, 1):
        starts[k] += alpha[0][:, kind == k].sum(axis=1)
    cell = symbol[:, None, :] * states + np.arange(states)[:, None]
    emits += np.bincount(cell.ravel(), alpha.ravel(), emits.size).reshape(emits.shape)
    return float(np.log(scale).sum())


def train(corpus: Corpus, states: int = STATES, rounds: int = ROUNDS, seed: int = 7) -> tuple[Model, list[float]]:
    """The model after ``rounds`` of Baum-Welch over all training texts, and the log-likelihood before each round."""
    model, classes, history = _first_model(corpus, states, seed), corpus.classes, []
    model.emit = np.ascontiguousarray(model.emit)
    share = (corpus.class_tokens + 1) / (corpus.class_tokens.sum() + classes + 1)
    source = corpus.blocks.select("held", "sizes", "codes", "word_class")
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            starts, moves, emits, total = np.zeros((2, states)), np.zeros((states, states)), np.zeros((classes + 1, states)), 0.0
            for batch in batches:
                for row in batch.to_pylist():
                    _, tokens, sizes = _class_runs(row, classes)
                    first, size, text, kind = _runs(sizes, PASSAGE)
                    learn = np.flatnonzero(~np.array(row["held"], bool)[text])
                    learn = learn[np.argsort(size[learn], kind="stable")]
                    for part in np.array_split(learn, -(-len(learn) // 2048)) if len(learn) else []:
                        total += _expected(model, tokens, first[part], size[part], kind[part], starts, moves, emits)
            values = np.concatenate([emits, starts, moves * model.move, np.full((1, states), total)])
            at = np.flatnonzero(values.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), *(pa.array(values[at, k]) for k in range(states))], names=["at", *(f"s{k}" for k in range(states))])

        schema = "at long, " + ", ".join(f"s{k} double" for k in range(states))
        sums = source.mapInArrow(run, schema).groupBy("at").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(states)))
        values = np.zeros((classes + 1 + 2 + states + 1, states))
        for r in sums.collect():  # a row for each class, start and state
            values[r[0]] = r[1:]
        emits, starts, moves = values[: classes + 1], values[classes + 1 : classes + 3], values[classes + 3 : -1]
        history.append(float(values[-1, 0]))
        model = Model((starts + 1) / (starts + 1).sum(axis=1, keepdims=True),
                      (moves + 1) / (moves + 1).sum(axis=1, keepdims=True),
                      (emits + PRIOR * share[:, None]) / (emits.sum(axis=0) + PRIOR))
    return model, history


# ---------------------------------------------------------------- scores


def log_likelihood(model: Model, tokens: np.ndarray, sizes: np.ndarray, limit: int = RUN) -> np.ndarray:
    """Natural log of the probability of each run of classes (texts end to end), by the scaled forward recursion."""
    first, size, text, later = _runs(sizes, limit)
    states = model.move.shape[0]
    # a text's first run starts as texts do; a later one starts from each state in turn, which gives its transfer matrix
    copies = np.where(later, states, 1)
    run = np.repeat(np.arange(len(size)), copies)
    state = np.arange(len(run)) - np.repeat(np.cumsum(copies) - copies, copies)
    vector = np.where(later[run][:, None], model.move[state], model.start[0])
    total = np.zeros(len(run))
    emit, back = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    order = np.argsort(-size[run], kind="stable")
    for part in np.array_split(order, max(1, -(-len(order) // 4096))):
        if not len(part):
            continue
        v, at, left = np.ascontiguousarray(vector[part].T), first[run[part]], size[run[part]]
        active = np.searchsorted(-left, -np.arange(int(left[0])), side="left").tolist()  # runs of more than t tokens
        logs = np.zeros(len(part))
        for t, n in enumerate(active):
            a = (v[:, :n] if t == 0 else back @ v[:, :n]) * np.take(emit, tokens[at[:n] + t], axis=1)
            s = a.sum(axis=0)
            np.divide(a, s, out=v[:, :n])
            logs[:n] += np.log(s)
        vector[part], total[part] = v.T, logs
    out = np.zeros(len(sizes))
    begin = np.cumsum(copies) - copies
    whole = np.flatnonzero(later == 0)
    out[text[whole]] = total[begin[whole]]
    for r in whole[sizes[text[whole]] > limit]:
        d, v = text[r], vector[begin[r]]
        r += 1
        while r < len(size) and text[r] == d:
            rows = slice(begin[r], begin[r] + states)
            logs = total[rows]
            top = logs.max()
            v = (v * np.exp(logs - top)) @ vector[rows]
            s = v.sum()
            v = v / s
            out[d] += top + np.log(s)
            r += 1
    return out


def score(corpus: Corpus, model: Model, doc_id: str = "doc_id") -> DataFrame:
    """Per text: id, held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score (unigrams with one
    added to each count) and score (the model); both log10."""
    classes, total = corpus.classes, corpus.tokens + corpus.distinct + 1
    of_class = np.log10(corpus.class_tokens + corpus.class_words + 1)
    ends, kind = corpus.class_tokens[-1], corpus.blocks.schema["ids"].dataType.elementType
    tokens_seen = corpus.tokens
    word = F.posexplode("words").alias("code", "word")
    # a word that one block alone has is counted there; the counts of others come from the table
    shared = corpus.words.filter("in_blocks > 1").select("word", "c")
    counts = (corpus.blocks.select("block", word).join(shared, "word")
              .groupBy("block").agg(F.collect_list(F.struct("code", "c")).alias("known")))  # a block's words: bounded
    counts = counts.select("block", F.col("known.code").alias("known"), F.col("known.c").alias("known_c"))
    schema = T.StructType([
        T.StructField(doc_id, kind), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                row = part.select(["held", "sizes", "codes", "word_class"]).to_pylist()[0]
                own = part.column("counts")[0].values.to_numpy()
                codes, tokens, sizes = _class_runs(row, classes)
                word_class = np.frombuffer(row["word_class"], "<u4")
                c = own.astype(np.int64)
                known, known_c = part.column("known")[0], part.column("known_c")[0]
                if known.is_valid:
                    c[known.values.to_numpy()] = known_c.values.to_numpy()
                base = np.log10((c + 1) / total)
                within = np.log10(c + 1.0) - of_class[word_class]
                text = np.repeat(np.arange(len(sizes)), sizes - 1)
                n = len(sizes)
                sums = [np.bincount(text, x[codes], n) if len(codes) else np.zeros(n) for x in (base, within, (c > 0).astype(float))]
                model_log = log_likelihood(model, tokens, sizes) / np.log(10)
                yield pa.RecordBatch.from_arrays([
                    part.column("ids")[0].values, pa.array(row["held"], pa.bool_()), pa.array(sizes),
                    pa.array(sums[2].astype(np.int64) + int(ends > 0)), pa.array(np.full(n, tokens_seen, np.int64)),
                    pa.array(sums[0] + np.log10((ends + 1) / total)), pa.array(sums[1] + model_log)], names=schema.names)

    return corpus.blocks.drop("words").join(counts, "block", "left").mapInArrow(run, schema)
