"""Merkle manifest, line deduplication and collocations against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortcast.llm import collocations, linededup, merkle
from cohortcast.llm.queries import QUERIES
from cohortcast.plans.oracle_check import _hash_frame, duck_connection

from .helpers import DOCS, SF, empty_docs, low, odd_docs


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fanout):
    """Root, and for each node its path of (left, right)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, place in enumerate(at):
            first = place - place % fanout
            paths[k].append(("".join(level[first:place]), "".join(level[place + 1 : first + fanout])))
            at[k] = place // fanout
        level = [h(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
    return level[0], paths


def manifest_of(rows, fields, fanout):
    """Counter of (doc_id, leaf, subroot, root, path)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf([r[f] for f in fields])))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])], fanout) for g in order}
    root, tops = tree([trees[g][0] for g in order], fanout)
    out = Counter()
    for g, top in zip(order, tops, strict=True):
        for (known, i, lf), path in zip(sorted(groups[g]), trees[g][1], strict=True):
            out[(i if known else None, lf, trees[g][0], root, tuple(path + top))] += 1
    return out


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.mark.parametrize(("fanout", "depth"), [(2, 2), (3, 1), (2, 8)])
def test_manifest_equals_a_tree_built_by_hand(spark, fanout, depth):
    rng = random.Random(fanout)
    rows = [(rng.choice([k, k // 3, None]), rng.choice(["", None, "né 漢", "x" * 50]), rng.choice([None, "en", "én", "", "zz"]), "s", k) for k in range(150)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    found = merkle.manifest(docs, FIELDS, "lang", "doc_id", fanout=fanout, depth=depth)
    want = manifest_of([r.asDict() for r in docs.collect()], FIELDS, fanout)
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in found.collect()) == want
    ends = found.select(merkle.folded(F.col("leaf"), F.col("path")).alias("f"), "root", merkle.proof_of(F.col("path")).alias("p"), "path").collect()
    for r in ends:
        assert r.f == r.root and r.p == h(*[s.left + s.right for s in r.path])


def test_manifest_odd_rows(spark):
    docs = odd_docs(spark)
    rows = merkle.manifest(docs, FIELDS, "lang", "doc_id").collect()
    assert len(rows) == docs.count() and len({r.root for r in rows}) == 1
    assert merkle.manifest(empty_docs(spark), FIELDS, "lang", "doc_id").count() == 0
    [one] = merkle.manifest(docs.limit(1), FIELDS, None, "doc_id").collect()
    assert one.leaf == one.subroot == one.root and one.path == []
    with pytest.raises(ValueError):
        merkle.manifest(docs, FIELDS, "lang", "doc_id", {"root": F.lit(1)})


def test_op11_finds_what_was_tampered_with(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op11_merkle"](spark, SF).collect():
        d = docs[r.doc_id]
        assert r.leaf == leaf([d[f] for f in FIELDS])
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0 or d.n_chars is None) == (r.folded_root == r.root)


def kept_lines(rows, min_chars, min_docs):
    """(n_lines, n_dropped, kept text) of each row."""
    strip = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key := low(line.strip(strip))) >= min_chars:
                holders[key].add((i is not None, i or 0))
    last = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if last.get(low(x.strip(strip)), (i is not None, i or 0)) == (i is not None, i or 0)]
        out.append((i, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return Counter(out)


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    lines = ["a common line of Words", " A common line of words\x0b", "é common line of wörds É", "short", "", " \t ", "another line of words here", "x" * 30_000]
    rows = [(rng.choice([k, k // 4, None]), None if k % 19 == 0 else "\n".join(rng.choice(lines) for _ in range(rng.choice([1, 2, 6, 40])))) for k in range(120)]
    rows += [(1, "a common line of Words\nmine"), (1, "a common line of Words\nmine"), (10**6, "a common line of words\na common line of words"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("own") for n in ("lines", "drop", "position", "key_1", "own", "id", "n_lines")})
    for min_chars, min_docs in ((10, 3), (22, 1), (23, 5)):
        out = linededup.drop_common_lines(docs, min_chars=min_chars, min_docs=min_docs)
        assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()) == kept_lines(rows, min_chars, min_docs)


def test_lines_of_many(spark):
    """A text of very many lines, most of which go."""
    long = "\n".join(f"this line is number {k % 4000} of a very long text" for k in range(100_000))
    docs = spark.createDataFrame([(k, long if k in (1, 6) else long[: 47 * 3000]) for k in range(1, 8)], "doc_id long, text string")
    rows = {r.doc_id: r for r in linededup.drop_common_lines(docs).collect()}
    want = {i: (n, d, t) for i, n, d, t in kept_lines([(r.doc_id, r.text) for r in docs.collect()], 40, 5)}
    assert {i: (r.n_lines, r.n_dropped, r.text) for i, r in rows.items()} == want
    assert linededup.drop_common_lines(empty_docs(spark)).count() == 0
    odd = odd_docs(spark)
    assert linededup.drop_common_lines(odd).count() == odd.count()


def phrases(rows, longest, least, absorb):
    """{(lang, phrase): (a, l, r, n, score)}."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", low(text)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for k in range(len(words) - size + 1):
                    f[lang, tuple(words[k : k + size])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, words), a in found.items():
        for size in range(2, len(words)):
            for k in range(len(words) - size + 1):
                part = lang, words[k : k + size]
                longer[part] = max(longer[part], a)
    out = {}
    for (lang, words), a in found.items():
        if 100 * longer[lang, words] < absorb * a:
            cuts = [(1_000_000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out[lang, " ".join(words)] = (a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score)
    return out


@pytest.mark.parametrize(("longest", "least", "batch"), [(3, 2, 50), (3, 4, 1 << 21), (2, 2, 1 << 21), (5, 2, 200)])
def test_collocations_equal_brute_force(spark, monkeypatch, longest, least, batch):
    monkeypatch.setattr(collocations, "BATCH", batch)
    monkeypatch.setattr(collocations, "PART", 64)
    rng = random.Random(longest)
    vocabulary = ["a", "The", "the", "né", "漢字", "x y", "it's", "\x1cz", "of", "b"]
    once = "one passage that stands in many documents word for word and has no stops at all in it"
    rows = [("".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!\r"]) for _ in range(rng.choice([0, 1, 2, 3, 30, 200]))),
             rng.choice([None, "en", "fr", "und"])) for _ in range(120)]
    rows += [(once, "en")] * 12 + [(f"and {once}", "en"), (f"{once} tail", "en"), (None, "en"), ("", None), ("a " * 3000, "xx"), ("b", "single")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    found = collocations.collocations(docs, longest=longest, least=least).collect()
    assert {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in found} == phrases(rows, longest, least, 50)
    assert len(found) == len({(r.lang, r.phrase) for r in found})


def test_paths_are_maximal_and_hold_every_edge_once(spark):
    once = "one passage that stands in many documents word for word and has no stops"
    docs = spark.createDataFrame([(once, "en")] * 11 + [("word for word and then", "en")] * 10, "text string, lang string")
    known = collocations.counts(docs, "text", F.col("lang"), 3, 10)
    at = lambda k: collocations.phrases_of(known, k)
    paths = {(" ".join(r.words), r["count"]) for r in collocations.compact(at(3), at(2), 3).collect()}
    assert paths == {("one passage that stands in many documents word for", 11), ("word for word and", 21),
                     ("word and has no stops", 11), ("word and then", 10)}


def test_ranks_and_ties(spark):
    docs = spark.createDataFrame([("a b. c d. e f. g h", "en")] * 10 + [("a x", "en")], "text string, lang string")
    top = collocations.report(collocations.collocations(docs), 3).orderBy("rank").collect()
    assert [(r["rank"], r.phrase, r.score) for r in top] == [(1, "c d", 1_000_000), (2, "e f", 1_000_000), (3, "g h", 1_000_000)]
    assert collocations.report(collocations.collocations(empty_docs(spark))).count() == 0
    assert collocations.collocations(odd_docs(spark), least=1).count() > 0


@pytest.mark.parametrize("name", ["op11_merkle", "op12_line_dedup", "op13_collocations"])
def test_equals_sql(spark, name):
    from cohortcast.llm.oracles import ORACLES

    own = QUERIES[name](spark, SF).toPandas()
    sql = duck_connection(SF).execute(ORACLES[name]).df()
    assert len(own) == len(sql) > 0 and _hash_frame(own) == _hash_frame(sql[list(own.columns)])
