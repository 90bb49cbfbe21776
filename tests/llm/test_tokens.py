import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortcast.llm import bpe, huffman
from cohortcast.llm.queries import BYTE_BPE, QUERIES, WORD_BPE

from .helpers import SF, empty_docs, odd_docs, odd_texts


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(BYTE_BPE), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts_of(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1_equals_library(spark, tik):
    texts = texts_of(spark)
    rows = QUERIES["op1_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pieces_of_any_length_merge_as_one_pair_at_a_time(tik):
    ranks = bpe.ranks_at(P.path(BYTE_BPE))
    rng = random.Random(1)
    for size in (1, 2, 5, 40, 255, 256, 257, 2000):
        for alphabet in ("a", "ab", "the ", "aeiorstn"):
            piece = "".join(rng.choice(alphabet) for _ in range(size)).encode()
            [ids] = ranks.encode_pieces([piece])
            parts = [bytes([b]) for b in piece]
            rank = {t: r for r, t in enumerate(ranks.tokens) if t}
            if size <= 300:  # the merges by their definition
                while True:
                    pairs = [(rank.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1)]
                    if not pairs or min(pairs)[0] == 1 << 60:
                        break
                    k = min(pairs)[1]
                    parts[k : k + 2] = [parts[k] + parts[k + 1]]
                assert ids.tolist() == [rank[p] for p in parts]
            assert b"".join(ranks.tokens[i] for i in ids) == piece


def test_bpe_odd_rows(spark, tik):
    docs = odd_docs(spark)
    for layout in ("binary", "array"):
        out = bpe.encode(docs, P.path(BYTE_BPE), P.PATTERN, layout=layout)
        assert out.columns == [c for c in docs.columns if c != "ids"] + ["ids"]
        rows = bpe.decode(out, P.path(BYTE_BPE)).collect()
        for r in rows:
            ids = list(r.ids) if layout == "array" else np.frombuffer(r.ids, "<u4").tolist()
            assert ids == tik.encode_ordinary(r.text or "")
            assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(empty_docs(spark), P.path(BYTE_BPE), P.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=200), st.integers(0, 10**6))
def test_huffman_round_trip(counts, seed):
    counts = np.array(counts)
    bits = huffman.code_lengths(counts)
    assert bits.max() <= huffman.MAX_BITS
    if len(counts) > 1:
        assert (0.5**bits).sum() == pytest.approx(1.0)
    ids = np.random.default_rng(seed).integers(0, len(counts), 1 + seed % 1000)
    code = huffman.Code(np.arange(len(counts)) * 3, bits)
    payload, checkpoints = code.encode(ids * 3)
    assert (code.decode(payload, checkpoints, len(ids)) == ids * 3).all()


def test_code_lengths_are_optimal_below_the_limit():
    import heapq

    counts = np.random.default_rng(1).integers(1, 1000, 300)
    heap, total = list(counts.tolist()), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    assert int((counts * huffman.code_lengths(counts, 40)).sum()) == total
    assert huffman.code_lengths(1 << np.arange(30), 8).max() == 8


def expected_files(texts):
    tokenizer, start = Tokenizer.from_file(P.path(WORD_BPE)), 0
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        yield doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_op10_equals_library(spark):
    rows = [tuple(r) for r in QUERIES["op10_token_files"](spark, SF).collect()]
    assert sorted(rows) == list(expected_files(sorted(texts_of(spark).items())))


def test_token_files_odd_rows(spark):
    docs = odd_docs(spark)
    for frame, n in ((docs, len(odd_texts())), (empty_docs(spark), 0)):
        path = huffman.scratch_path(spark)
        huffman.write_tokens(huffman.tokenize(frame, P.path(WORD_BPE), end_id=2, dtype="<u2"), path, dtype="<u2")
        rows = huffman.read_tokens(spark, path).collect()
        assert len(rows) == n
        if n:
            rows.sort(key=lambda r: r.start)
            assert rows[0].doc_id is None and rows[0].start == 0
            want = {}
            for r in docs.collect():
                ids = Tokenizer.from_file(P.path(WORD_BPE)).encode(r.text or "", add_special_tokens=False).ids + [2]
                want.setdefault(r.doc_id, []).append(np.array(ids, "<u4").tobytes())
            got = {}
            for a, b in zip(rows, rows[1:]):
                assert b.start == a.start + len(a.ids) // 4
            for r in rows:
                got.setdefault(r.doc_id, []).append(bytes(r.ids))
            assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_parts_equal_whole_texts():
    tokenizer = huffman._tokenizer(P.path(WORD_BPE))
    parts, rng = huffman.Parts(tokenizer), random.Random(3)
    alphabet = "abcXYZ012 \n\t.,!?'\"#*&<|>éÉ漢ß\u0338\u0301 \x1c\x85—'s't"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 200))) for _ in range(300)]
    texts += ["<|startoftext|>a <|ENDOFTEXT|>", "a<|b ... C!!", "İstanbul ẞ ǅ ſ's KK!", "a\x00b \u200d!!", "", "  ", None]
    for k in range(0, len(texts), 50):
        column = pa.array(["other", *texts[k : k + 50]]).slice(1)  # offsets that begin above 0
        found = huffman.encoded(column, parts, 2, "<u2").to_pylist()
        for text, ids in zip(texts[k : k + 50], found, strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
    column = pa.array([], pa.string())
    assert huffman.encoded(column, parts, 2, "<u2").to_pylist() == []
