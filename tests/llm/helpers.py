import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def odd_texts():
    """Null, empty, very long, repeated and unusual texts."""
    rng = random.Random(4)
    words = ["the", "The", "of,", "né", "漢字", "it's", "x9", "don't!!", "a|b", "ĳ", "🎉", "THING"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    return [None, "", " \t\n ", "a", "a" * 3000, long, "same text here for you all", "same text here for you all",
            "\x00\x1c\x85 x", "word\u00a0word \u2003wide", "<|endoftext|> <|x|>", "ß" * 700 + "!" * 900, "one two three four"]


def odd_docs(spark, extra=True):
    """``odd_texts`` with null and repeated ids, nulls in all columns, and columns that clash with names used inside."""
    ids = [0, 1, 2, 3, 4, 5, 6, 7, None, 9, 9, 10, 11]
    rows = [(i, t, None if k % 3 else "en", None if k % 2 else "s", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, odd_texts(), strict=True))]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        names = ["ids", "score", "row", "features", "spans", "runs", "base_spans", "items", "n_words", "set", "rep", "text_", "held"]
        df = df.withColumns({n: F.lit("own") for n in names})
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
