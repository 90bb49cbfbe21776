"""The registered queries ``opN_<name>`` and ``pipeline``: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, capfilter, collocations, decontaminate, hmm, huffman, jaccard, linededup, merkle, quality, secrets, toxicity, urls
from .common import fold, read, staged
from .oracles import ORACLES as ORACLES

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every text and of the bytes that they decode to."""
    path = public_tokenizers.path(BYTE_BPE)
    ids = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN,
                     keep=["doc_id"])
    return bpe.decode(ids, path).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every text, by a model of the texts whose crc32 fold of 7 isn't 2."""
    corpus = hmm.index(read(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)
    model, _ = hmm.train(corpus)
    return hmm.score(corpus, model)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark window, the items these belong to, and the longest match."""
    judged = decontaminate.contamination(read(spark, sf_dir, "documents").select("doc_id", "text"),
                                         read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"), "longest", "longest_word", "longest_item", "longest_item_word")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document, by shingles of five words at a similarity of 0.8."""
    found = jaccard.similar(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_links", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector, by a cosine of 0.95."""
    found = capfilter.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: what the rules find, and all spans."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = staged(secrets.annotate(docs).drop("text"), "secrets")
    base = secrets.add_spans(found, secrets.fit(found))
    number = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return base.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(secrets.listed(F.array_sort("base_spans")).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learnt from the labelled texts whose crc32 fold of 3 isn't 1."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learnt from the labelled texts whose crc32 fold of 4 isn't 2."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page by the rules, else by its host's trust and distrust."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return urls.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, written as Huffman-coded files and read back."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path = huffman.scratch_path(spark)
    ids = huffman.tokenize(docs, public_tokenizers.path(WORD_BPE), end_id=2, dtype="<u2", keep=["doc_id"])  # 49,408 ids
    huffman.write_tokens(ids, path, dtype="<u2")
    return huffman.read_tokens(spark, path).select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of the documents by language, and what becomes of the root where a row's n_chars was tampered with."""
    docs = read(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = merkle.leaf_of(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields])
    rows = merkle.manifest(docs, fields, "lang", "doc_id", {"changed": F.when(tampered, changed)})
    again = merkle.folded(F.coalesce("changed", "leaf"), F.col("path"))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_of(F.col("path")).alias("proof_sha256"),
                       again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines that five documents or more share."""
    kept = linededup.drop_common_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best 2,000 phrases of two or three words."""
    return collocations.report(collocations.collocations(read(spark, sf_dir, "documents").select("text", "lang")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_hidden_markov": op2_hidden_markov,
    "op3_decontamination": op3_decontamination,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_url_filter": op9_url_filter,
    "op10_token_files": op10_token_files,
    "op11_merkle": op11_merkle,
    "op12_line_dedup": op12_line_dedup,
    "op13_collocations": op13_collocations,
}
