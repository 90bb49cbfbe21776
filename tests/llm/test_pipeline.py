import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

import __spark_entry__
from cohortcast.llm import bpe, decontaminate, jaccard, secrets
from cohortcast.llm.common import read, staged

from .helpers import DOCS, SF, odd_docs


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


def test_stages_take_effect(spark):
    docs = read(spark, SF, "documents")
    planted = spark.createDataFrame([(10**6, "token=abcdef123456 first here", "en", "s", 29), (10**6 + 1, docs.first().text, "en", "s", 1)], DOCS)
    docs = staged(docs.unionByName(planted), "planted")
    ids = [set(r.doc_id for r in docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SF), name)
        if name != "tokens":
            assert out.schema.simpleString() == docs.schema.simpleString()
        ids.append(set(r.doc_id for r in out.select("doc_id").collect()))
        assert ids[-1] <= ids[-2]
        if name == "near_duplicates":
            kept = {r.doc_id for r in jaccard.similar(docs).collect() if r.doc_id == r.class_id}
            assert ids[-1] == kept and 10**6 + 1 not in kept
        if name == "decontamination":
            judged = decontaminate.contamination(docs, read(spark, SF, "benchmark")).filter(~decontaminate.contaminated())
            assert ids[-1] == {r.doc_id for r in judged.collect()}
        if name == "secrets":
            assert ids[-1] == ids[-2]
            row = out.filter("doc_id = 1000000").first()
            assert row.text == f"{secrets.MASK} first here" and row.n_chars == len(row.text)
        if name == "tokens":
            ranks = bpe.ranks_at(P.path("byte_bpe_multi_50k.tiktoken"))
            texts = {r.doc_id: r.text or "" for r in docs.collect()}
            for r in out.collect():
                decoded = b"".join(ranks.tokens[i] for i in np.frombuffer(r.ids, "<u4"))
                assert decoded == texts[r.doc_id].encode() and r.decoded_sha256 == hashlib.sha256(decoded).hexdigest()
        docs = out


def test_stages_take_odd_rows(spark):
    docs = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SF), name)
        if name != "tokens":
            assert out.columns == docs.columns
            assert out.filter(F.col("text").isNull()).count() == 1
        docs = out
    empty = odd_docs(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = staged(stage(spark, empty, SF), name)
        assert empty.count() == 0
