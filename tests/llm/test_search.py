"""Decontamination, near-duplicates of texts and of vectors, against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest

from cohortcast.llm import capfilter, decontaminate, jaccard
from cohortcast.llm.graph import connected_components
from cohortcast.llm.queries import QUERIES

from .helpers import DOCS, SF, empty_docs, low, odd_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items, window=13):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = WORD.findall(low(text))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])].add(str(item))
    out = {}
    for key, text in docs:
        w, hit, found = WORD.findall(low(text)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if items := windows.get(tuple(w[k : k + n])):
                    found |= items
                    hit.update(range(k, k + n))
        out[key] = len(w), len(hit), found
    return out


def brute_longest(text, items):
    """The longest match of a text with any item: the first in the text, then by the item's id and place in it."""
    w, best, starts = WORD.findall(low(text)), (0, None, None, None), collections.defaultdict(list)
    items = sorted((str(i), t) for i, t in items)
    words = [WORD.findall(low(t)) for _, t in items]
    for n, item in enumerate(words):
        for k, x in enumerate(item):
            starts[x].append((n, k))
    for at in range(len(w)):
        for n, k in starts[w[at]]:
            size, item = 0, words[n]
            while at + size < len(w) and k + size < len(item) and w[at + size] == item[k + size]:
                size += 1
            if size > best[0]:
                best = (size, at, items[n][0], k)
    return best


def longest_of(row):
    return row.longest, row.longest_word, row.longest_item, row.longest_item_word


def test_op3_longest_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 4 = 0")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {r.doc_id: brute_longest(r.text, items) for r in docs.collect()}
    got = {r.doc_id: longest_of(r) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == want and max(m[0] for m in want.values()) >= decontaminate.WINDOW


@pytest.mark.parametrize("seed", range(4))
def test_longest_in_few_words(spark, monkeypatch, seed):
    """Texts of a few different words, so that matches tie, overlap and end at the ends of texts and items."""
    rng = np.random.default_rng(seed)

    def text():
        return " ".join(rng.choice(list("abcdz"), rng.integers(0, 30), p=[0.35, 0.3, 0.2, 0.1, 0.05]))

    docs = [(k, text()) for k in range(150)]
    items = [(str(rng.integers(0, 12)), text().replace("z", "y")) for _ in range(20)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = {}
    for size in (1 << 24, 200):  # in one block and in several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        monkeypatch.setattr(decontaminate, "SHARD", 100)
        found[size] = {r.doc_id: longest_of(r) for r in decontaminate.contamination(rows, bench, window=4).collect()}
    want = {k: brute_longest(t, items) for k, t in docs}
    # items that share an id are told apart by their words, so of these any may be named
    for got in found.values():
        assert {k: m[:3] for k, m in got.items()} == {k: m[:3] for k, m in want.items()}
        for k, (size, at, item, start) in got.items():
            if size:
                w = WORD.findall(low(docs[k][1]))[at : at + size]
                assert any(i == item and WORD.findall(low(t))[start : start + size] == w for i, t in items)


def test_op3_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_hits(docs, items)
    rows = QUERIES["op3_decontamination"](spark, SF).collect()
    assert len(rows) == len(docs) and any(r.contaminated for r in rows)
    for r in rows:
        n, hit, found = want[r.doc_id]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, hit, len(found), digest)
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_decontaminate_odd_rows(spark, monkeypatch):
    docs = odd_docs(spark)
    items = [(1, "same text here for you all"), (None, "one two three four"), (2, None), (3, ""), (3, "né"), (4, "a a a"), (4, "the the the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = [("" if i is None else i, t) for i, t in items if t]
    want = brute_hits([(k, r.text) for k, r in enumerate(docs.collect())], clean)
    for size in (1 << 24, 40):  # in one block and in several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = decontaminate.contamination(docs, bench).collect()
        for k, r in enumerate(got):
            assert (r.n_words, r.n_hit, set(r["items"])) == want[k]
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not (h > 0 and 20 * h >= n) for n, h, _ in want.values())
    nothing = bench.limit(0)
    assert decontaminate.decontaminate(docs, nothing).count() == docs.count()
    assert decontaminate.contamination(empty_docs(spark), bench).count() == 0


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x a b c d e y", None, None, 0), (2, "a b c d q a b c d e f", None, None, 0), (3, None, None, None, 0)], DOCS)
    bench = spark.createDataFrame([(7, "a b c d e f g")], "item_id long, text string")
    rows = {r.item_word: (r.n_words, r.doc_id, r.doc_word) for r in decontaminate.longest_matches(docs, bench, least=3).collect()}
    assert rows == {0: (6, 2, 5), 1: (5, 2, 6), 2: (4, 2, 7), 3: (3, 2, 8)}


def brute_similar(docs, threshold=0.8):
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n, parent, links = len(docs), list(range(len(docs))), [0] * len(docs)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if docs[i][0] is None or docs[j][0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if both and both / (len(sets[i]) + len(sets[j]) - both) >= threshold - 1e-12:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i in range(n):
        if docs[i][0] is not None:
            least[find(i)] = min(least.get(find(i), docs[i][0]), docs[i][0])
    return [(docs[i][0], None if docs[i][0] is None else least[find(i)], links[i]) for i in range(n)]


def key(row):
    return tuple((x is not None, x) for x in row)


def near_copies():
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(400)]
    docs = [(i, " ".join(rng.choice(words, size=60))) for i in range(20)]
    base = docs[3][1].split()
    for i in range(20, 120):  # a large group of near and exact copies
        w = list(base)
        for at in rng.integers(0, 60, size=int(rng.integers(0, 2))):
            w[at] = f"new{rng.integers(0, 30)}"
        docs.append((i, " ".join(w)))
    return docs + [(200, None), (201, ""), (202, "two words"), (203, "Two  Words"), (None, "two words"), (204, "two"), (3, docs[3][1]), (205, "long " * 9000)]


@pytest.mark.parametrize("blocks", [(2048, 10**6), (16, 500)])
def test_jaccard_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", blocks[0])
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", blocks[1])
    docs = near_copies()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = [(r.doc_id, r.class_id, r.n_links) for r in jaccard.similar(df).collect()]
    assert sorted(rows, key=key) == sorted(brute_similar(docs), key=key)
    kept = jaccard.keep_one(df.selectExpr("*", "'x' as set", "1 as _nth_row")).collect()
    want = {c for _, c, _ in brute_similar(docs) if c is not None}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in kept) == 1


def test_an_id_with_different_texts(spark):
    words = [f"w{k}" for k in range(120)]
    x, a, b = (" ".join(words[k : k + 40]) for k in (0, 40, 80))
    # (3, near x) follows 1, (3, a) leads 5; 8 has two unlike texts; 9 a copy of one row and a bare row
    docs = [(1, x), (3, x + " end"), (3, a), (5, a + " end"), (8, b), (8, "one two three four"), (9, "nine ten"), (9, "nine ten"), (9, "")]
    want = sorted([docs[0], docs[2], docs[4], docs[5], docs[6], docs[8]])
    for parts in (1, 5):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        assert sorted(tuple(r) for r in jaccard.keep_one(df).collect()) == want


def test_jaccard_of_the_fixture(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op4_jaccard_join"](spark, SF).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in rows) == sorted(brute_similar(docs))


def test_jaccard_odd_rows(spark):
    docs = odd_docs(spark)
    rows = jaccard.similar(docs).collect()
    assert len(rows) == docs.count()
    assert jaccard.keep_one(docs).columns == docs.columns
    assert jaccard.similar(empty_docs(spark)).count() == 0
    assert jaccard.keep_one(empty_docs(spark)).count() == 0


def test_prefix_is_shortened_to_the_target():
    depth = jaccard.prefix_length(0.8)
    assert 1 - (1 - 0.8**depth) ** jaccard.TREES >= jaccard.RECALL > 1 - (1 - 0.8 ** (depth + 1)) ** jaccard.TREES
    assert jaccard.prefix_length(1.0) == jaccard.DEPTH


def test_common_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 200, size=rng.integers(1, 90))).astype(np.uint64) for _ in range(50)]
    square = jaccard.common(sets, None)
    pair = jaccard.common(sets[:20], sets[20:])
    for i in range(50):
        for j in range(50):
            if i != j:
                assert square[i, j] == len(np.intersect1d(sets[i], sets[j]))
                if i < 20 <= j:
                    assert pair[i, j - 20] == square[i, j]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (6, 6), (7, 7), (20, 19), (19, 18), (18, 17), (17, 16)]
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.vertex: r.component for r in rows} == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, 20: 16, 19: 16, 18: 16, 17: 16, 16: 16}


def brute_near(rows, threshold=0.95):
    n, links, parent = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def good(i, v):
        return i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)

    ok = [good(i, v) for i, v in rows]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], float) for k in (i, j))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted([(rows[i][0], links[i], None if rows[i][0] is None else least[find(i)]) for i in range(n)], key=key)


@pytest.mark.parametrize("block", [1024, 8])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(capfilter, "BLOCK_VECTORS", block)
    rng = np.random.default_rng(1)
    rows, center = [], rng.normal(size=32)
    for i in range(60):
        rows.append((i, rng.normal(size=32).tolist()))
    for i in range(60, 140):  # a large group, with exact copies and multiples
        v = center + 0.08 * rng.normal(size=32) * (i % 3 > 0)
        rows.append((i, (v * (1 + i % 2)).tolist()))
    nan, inf = float("nan"), float("inf")
    rows += [(200, None), (201, [0.0] * 32), (202, [nan] * 32), (203, [inf] + [1.0] * 31), (204, []), (205, [1.0, 2.0]), (206, [2.0, 4.0]),
             (None, center.tolist()), (207, [1e-30, 2e-30]), (61, center.tolist()), (208, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as h", "2 as rep")
    rows32 = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted([(r.vec_id, r.n_links, r.component_id) for r in capfilter.near_duplicates(df).collect()], key=key)
    assert got == brute_near(rows32)
    assert capfilter.near_duplicates(df.limit(0)).count() == 0


def test_op5_recall(spark):
    rows = QUERIES["op5_embedding_dedup"](spark, SF).collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute_near(vectors)
    found, there = sum(r.n_links for r in rows), sum(w[1] for w in want)
    assert len(rows) == len(vectors) and found >= 0.9 * there and found <= there


def test_filter_recall_near_the_threshold():
    rng = np.random.default_rng(5)
    met = 0
    for _ in range(200):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        z = rng.normal(size=64)
        z -= (z @ a) * a
        b = 0.95 * a + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z)
        listed = capfilter.listed_for(64, 0.95)
        met += len(np.intersect1d(capfilter.filters(a, listed=listed), capfilter.filters(b, listed=listed))) > 0
    assert met >= 180
