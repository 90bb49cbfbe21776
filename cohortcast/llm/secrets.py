"""Secret scans with DataFrame functions only.

Rules find assignments, access keys and long hexadecimal runs.  Besides, two character Markov models (each character
given the one before) judge every run of ``LEAST`` or more characters of the base64 and identifier alphabets: one of
random strings, one of ordinary identifiers.  A run whose log-likelihood ratio reaches ``MARGIN`` is a secret of kind
``markov``, unless it overlaps one that a rule found.

The models are trained from the corpus itself, with the rules as labels: the values that the rules find are samples of
random strings, the runs without such a value samples of ordinary identifiers.  The counts cover all rows; the models
are two tables of the alphabet's size squared.  Without samples of both kinds only the rules apply.

Positions are in code points, ends exclusive.  A null text counts as empty and has no spans; repeated rows are scanned
one by one.  Helper columns are named by ``base_spans``, ``runs`` and ``spans``, which replace input columns so named.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans of the same start are listed.
KINDS = ("assign", "access", "hex", "markov")
RULES = (
    ("(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    ("AKIA[A-Z0-9]{16,}", 0, 20),
    ("[0-9a-f]{24,}", 0, 24),
)
LEAST = 16
RUN = "[A-Za-z0-9+/_=-]{%d,}" % LEAST
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WIDTH = len(ALPHABET) + 1  # 0: the start
#: Least log-likelihood ratio (natural log) of a secret.
MARGIN = 12.0
#: Added to each pair's count in the models of ordinary and of random strings: random ones may hold any pair.
ADDED = (0.05, 1.0)
MASK = "<secret>"

SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def found(text: Column, pattern: str, group: int, kind: int, least: int) -> Column:
    """Leftmost non-overlapping matches, without those whose group has fewer than ``least`` characters.

    A split by the same pattern gives the text between matches, whose lengths place them.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    parts = parts.cast("array<struct<between:string,match:string,value:string>>")

    def step(so_far: Column, part: Column) -> Column:
        start = so_far["at"] + F.length(part["between"])
        end = start + F.coalesce(F.length(part["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), part["value"].alias("value"))
        good = F.length(part["value"]) >= least
        spans = F.when(F.coalesce(good, F.lit(False)), F.array_append(so_far["spans"], span)).otherwise(so_far["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    matches = F.aggregate(parts, zero, step)["spans"]
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), matches).otherwise(F.array().cast(SPANS))


def annotate(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with base_spans (what the rules find) and runs (candidates of the models)."""
    t = F.col(text)
    rules = [found(t, pattern, group, kind, least) for kind, (pattern, group, least) in enumerate(RULES)]
    df = df.select(*[c for c in df.columns if c not in ("base_spans", "runs", "spans")])
    return df.withColumns({"base_spans": F.concat(*rules), "runs": found(t, RUN, 0, 3, LEAST)})


def _clear(run: Column, spans: Column) -> Column:
    """The run overlaps none of the spans."""
    return ~F.exists(spans, lambda s: (s["start"] < run["end"]) & (run["start"] < s["end"]))


def fit(annotated: DataFrame) -> list[float] | None:
    """Log-likelihood ratio of each pair of characters (previous code times ``WIDTH`` plus code)."""
    random = annotated.select(F.explode("base_spans.value").alias("value"), F.lit(1).alias("random"))
    ordinary = annotated.select(F.explode(F.filter("runs", lambda r: _clear(r, F.col("base_spans")))["value"]).alias("value"),
                                F.lit(0).alias("random"))
    samples = random.unionByName(ordinary)
    pairs = samples.select("random", F.explode(F.sequence(F.lit(1), F.length("value"))).alias("k"), "value")
    now = F.expr(f"instr('{ALPHABET}', substr(value, k, 1))")
    before = F.expr(f"if(k = 1, 0, instr('{ALPHABET}', substr(value, k - 1, 1)))")
    rows = pairs.groupBy("random", before.alias("a"), now.alias("b")).count().collect()  # at most 2 x WIDTH x WIDTH
    counts = [[x] * WIDTH * WIDTH for x in ADDED]
    for r in rows:
        # a run is judged by ordinary strings without itself: of each of its pairs, one fewer
        counts[r["random"]][r["a"] * WIDTH + r["b"]] += r["count"] if r["random"] else r["count"] - 1
    if {r["random"] for r in rows} != {0, 1}:
        return None
    rates = []
    for table in counts:
        totals = [sum(table[a * WIDTH : (a + 1) * WIDTH]) for a in range(WIDTH)]
        rates.append([math.log(x / totals[k // WIDTH]) for k, x in enumerate(table)])
    return [r - o for o, r in zip(*rates, strict=True)]


def ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")  # folded into one literal

    def step(so_far: Column, character: Column) -> Column:
        code = F.instr(F.lit(ALPHABET), character)
        return F.struct(code.alias("code"), (so_far["sum"] + F.get(table, so_far["code"] * WIDTH + code)).alias("sum"))

    return F.aggregate(F.split(value, ""), F.struct(F.lit(0).alias("code"), F.lit(0.0).alias("sum")), step)["sum"]


def add_spans(annotated: DataFrame, model: list[float] | None) -> DataFrame:
    """``annotated`` with spans: those of the rules and of the models, by start and then kind."""
    every = F.col("base_spans")
    if model is not None:
        more = F.filter("runs", lambda r: _clear(r, F.col("base_spans")) & (ratio(r["value"], model) >= MARGIN))
        every = F.concat(every, more)
    return annotated.withColumn("spans", F.array_sort(every))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redacted(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with each stretch that sorted spans cover replaced by the mask."""

    def step(so_far: Column, span: Column) -> Column:
        apart = span["start"] >= so_far["at"]
        ahead = F.concat(so_far["out"], F.substring(text, so_far["at"] + 1, span["start"] - so_far["at"]), F.lit(mask))
        return F.struct(F.greatest(so_far["at"], span["end"]).alias("at"),
                        F.when(apart, ahead).otherwise(so_far["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda x: F.concat(x["out"], F.substring(text, x["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
