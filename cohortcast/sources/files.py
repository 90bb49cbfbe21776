"""File sources and sinks (A1-A15): landed extracts, run-spec CSV, sampler CSV,
run directories and result tables.

Everything is a DataFrame reader/writer; partition columns (``lexis``, ``Country``,
``run``) make the reference's path building a partition-pruning predicate.  Sinks
write below a directory on the shared filesystem (the checkpoint directory's
parent by default, never a machine-local temp path on a cluster).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rates import harmonise_headers
from ..operators.small import numbered
from ..session import ensure_checkpoint_dir

LEXIS = {"Cohort": "VV", "Period": "RR"}  # A3: Lexis shape of each time axis


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory for written tables next to the (shared) checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(os.path.dirname(base.rstrip("/")), "cohortcast-tables", f"{name}-{uuid.uuid4().hex}")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet",
                mode: str = "overwrite") -> str:
    """Result sink (overwrite by default), optionally partitioned."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)
    return path


# --- A1-A7: landed births / exposure extracts ----------------------------------------
def write_extracts(births: DataFrame, expos: DataFrame, base: str, lexis: str = "VV", mode: str = "overwrite") -> None:
    """Land extracts as ``base/{births,expos}/lexis=../Country=..`` with the source's
    headers (``Total`` for births, ``ARDY`` for age)."""
    b = births.withColumnRenamed("Births", "Total").withColumnRenamed("Age", "ARDY").withColumn("lexis", F.lit(lexis))
    e = expos.withColumnRenamed("Age", "ARDY").withColumn("lexis", F.lit(lexis))
    write_table(b.withColumn("OpenInterval", F.lit(False)), os.path.join(base, "births"), ["lexis", "Country"], mode=mode)
    write_table(e.withColumn("OpenInterval", F.lit(False)), os.path.join(base, "expos"), ["lexis", "Country"], mode=mode)


def read_item(spark: SparkSession, base: str, item: str, lexis: str = "VV",
              exclude: tuple[str, ...] = ("CHL",)) -> DataFrame:
    """A1-A5: one item for all countries; lexis is a partition predicate (pruned),
    headers harmonised, excluded countries filtered."""
    df = spark.read.parquet(os.path.join(base, item)).filter(F.col("lexis") == lexis)
    if exclude:
        df = df.filter(~F.col("Country").isin(*exclude))
    return harmonise_headers(df).drop("lexis")


def data_vintage(df: DataFrame, date_col: str) -> DataFrame:
    """(Country, HFD_date) vintage table."""
    return df.groupBy("Country").agg(F.max(F.to_date(date_col)).alias("HFD_date"))


# --- A8-A9: run specification CSV ------------------------------------------------------
RUN_SPEC_SCHEMA = T.StructType([
    T.StructField(n, T.StringType()) for n in
    ("param_type_1", "param_type_2", "model_name", "country", "dispersion", "base_config")
])


def write_run_specs(specs: DataFrame, path: str) -> str:
    cols = [f.name for f in RUN_SPEC_SCHEMA.fields]
    return _write_csv(specs.select(*cols), path)


def _write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_run_specs(spark: SparkSession, path: str) -> DataFrame:
    """A8 with an explicit schema; A9: every run gets an explicit ``run_id`` (all runs are
    processed in one job instead of one process per CSV line)."""
    df = spark.read.option("header", True).schema(RUN_SPEC_SCHEMA).csv(path)
    rows = numbered(df, ["country", "param_type_1", "param_type_2", "model_name", "dispersion", "base_config"], "run_id")
    return rows.withColumn("run_id", F.col("run_id").cast("int"))


# --- A14: sampler output CSV ------------------------------------------------------------
def write_sampler_csv(sampler: DataFrame, stepsize: DataFrame, base: str, elapsed: DataFrame | None = None) -> str:
    """Write per-(Country, Chain) sampler files like the sampler's CSV output: '#'
    comment lines carrying the adaptation text, a header, then one line per iteration, and
    closing comments with the seconds of warm-up and sampling (``elapsed``: Country, Chain, warmup, sampling)."""
    cols = ["divergent__", "treedepth__", "energy__"]
    data = sampler.select("Country", "Chain", F.col("Iter").cast("long").alias("ord"),
                          F.concat_ws(",", *[F.col(c).cast("string") for c in cols]).alias("line"))
    head = stepsize.select("Country", "Chain", F.lit(-2).cast("long").alias("ord"),
                           F.concat(F.lit("# Step size = "), F.col("stepsize").cast("string")).alias("line"))
    head2 = stepsize.select("Country", "Chain", F.lit(-3).cast("long").alias("ord"),
                            F.lit("# Adaptation terminated").alias("line"))
    hdr = stepsize.select("Country", "Chain", F.lit(-1).cast("long").alias("ord"), F.lit(",".join(cols)).alias("line"))
    lines = data.unionByName(head).unionByName(head2).unionByName(hdr)
    if elapsed is not None:
        last = F.lit((1 << 62) + 0)
        for k, (column, phase, lead) in enumerate((("warmup", "Warm-up", "#  Elapsed Time: "), ("sampling", "Sampling", "#                "))):
            lines = lines.unionByName(elapsed.select("Country", "Chain", (last + F.lit(k)).alias("ord"), F.concat(
                F.lit(lead), F.col(column).cast("string"), F.lit(f" seconds ({phase})")).alias("line")))
    out = (lines.repartition("Country", "Chain").sortWithinPartitions("Country", "Chain", "ord")
           .select("Country", "Chain", "line"))
    out.write.mode("overwrite").partitionBy("Country", "Chain").text(base)
    return base


SAMPLER_SCHEMA = T.StructType([
    T.StructField("divergent__", T.IntegerType()), T.StructField("treedepth__", T.IntegerType()),
    T.StructField("energy__", T.DoubleType()),
])


def read_sampler_csv(spark: SparkSession, base: str) -> DataFrame:
    """A14 + E6: '#' comments skipped, Chain taken from the file path, ``iter`` = row
    number in file order (rows of a file keep their order within and across splits)."""
    df = (spark.read.option("comment", "#").option("header", True).schema(SAMPLER_SCHEMA)
          .csv(os.path.join(base, "*", "*")).withColumn("_file", F.col("_metadata.file_path"))
          .withColumn("_ord", F.monotonically_increasing_id()))
    w = Window.partitionBy("_file").orderBy("_ord")
    return df.select(
        F.url_decode(F.regexp_extract("_file", r"Country=([^/]+)/", 1)).alias("Country"),
        F.regexp_extract("_file", r"Chain=(\d+)/", 1).cast("int").alias("Chain"),
        F.row_number().over(w).alias("iter"),
        "divergent__", "treedepth__", "energy__",
    )


def read_stepsizes(spark: SparkSession, base: str) -> DataFrame:
    """Step size per chain parsed from the adaptation comment text."""
    t = spark.read.text(os.path.join(base, "*", "*")).withColumn("_file", F.col("_metadata.file_path"))
    t = t.filter(F.col("value").startswith("#") & F.col("value").contains("Step size"))
    return t.select(
        F.url_decode(F.regexp_extract("_file", r"Country=([^/]+)/", 1)).alias("Country"),
        F.regexp_extract("_file", r"Chain=(\d+)/", 1).cast("int").alias("Chain"),
        F.regexp_extract("value", r"[0-9]+\.[0-9]+", 0).cast("double").alias("stepsize"),
    )


def read_elapsed(spark: SparkSession, base: str) -> DataFrame:
    """Seconds of warm-up and sampling per chain, parsed from the closing comments of the sampler files."""
    t = spark.read.text(os.path.join(base, "*", "*")).withColumn("_file", F.col("_metadata.file_path"))
    t = t.filter(F.col("value").startswith("#") & F.col("value").contains(" seconds ("))
    seconds = F.regexp_extract("value", r"([0-9]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?) seconds", 1).cast("double")
    of = lambda phase: F.max(F.when(F.col("value").contains(f"({phase})"), seconds))
    return t.groupBy(F.url_decode(F.regexp_extract("_file", r"Country=([^/]+)/", 1)).alias("Country"),
                     F.regexp_extract("_file", r"Chain=(\d+)/", 1).cast("int").alias("Chain")).agg(
        of("Warm-up").alias("warmup"), of("Sampling").alias("sampling"))


# --- A11-A12: run directories -----------------------------------------------------------
RUN_STAMP = r"20[0-9]{6}_[0-9]{6}"


def latest_run(spark: SparkSession, base: str) -> DataFrame:
    """A11 + A12 + G2: read every run directory (schemas merged, missing columns NULL),
    keep the latest run (top-1 by name = max of the stamp, F2)."""
    df = spark.read.option("mergeSchema", True).parquet(base)
    df = df.filter(F.col("run").rlike(f"^{RUN_STAMP}$"))
    latest = df.agg(F.max("run").alias("run"))
    return df.join(F.broadcast(latest), "run")
