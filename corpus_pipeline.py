"""Corpus pipeline: toxic documents and all but one of each group of near-duplicates go, then documents that hold
benchmark passages; secrets in the others are masked, and their texts become token ids.

Each stage takes (spark, docs, sf_dir) and keeps the columns of ``docs`` (extra ones too), but for the last.  Null and
empty texts pass every stage; rows with a null id are no duplicates of others.  The stages' operators say in their
docstrings what they do with ties, repeated rows and empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcast.llm import bpe, decontaminate, jaccard, secrets, toxicity
from cohortcast.llm.common import fold, read, renamed, staged, unnamed
from cohortcast.llm.queries import BYTE_BPE

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labels outside the held-out fold, doesn't reject."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    rows, own = unnamed(docs)
    return renamed(toxicity.score(rows, model, text=own["text"]).filter(F.col("score") < toxicity.THRESHOLD), own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than one in twenty lie in a benchmark window."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and the number of characters set anew where any were."""
    rows, own = unnamed(docs)
    found = staged(secrets.annotate(rows, own["text"]), "annotated")
    found = secrets.add_spans(found, secrets.fit(found.select("base_spans", "runs")))
    found = found.withColumn("masked", secrets.redacted(F.col(own["text"]), F.col("spans")))
    changes = {own["text"]: F.col("masked")}
    if "n_chars" in own:
        n_chars = F.length("masked").cast(docs.schema["n_chars"].dataType)
        changes[own["n_chars"]] = F.when(F.size("spans") > 0, n_chars).otherwise(F.col(own["n_chars"]))
    return renamed(found.select(*(changes.get(n, F.col(n)).alias(n) for n in own.values())), own)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the digest of the bytes that they decode to."""
    path = public_tokenizers.path(BYTE_BPE)
    ids = bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, keep=["doc_id"])
    return bpe.decode(ids, path).select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids",
                                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("tokens", encode_texts),
]

#: The stages hold trained models and tokenizers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written as Parquet and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
