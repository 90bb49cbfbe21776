"""A10: configurations in YAML files, as tables.

A folder of files, one configuration each, becomes one row per file with typed columns.  The files hold what run
configurations need: ``key: value`` lines, lists (``- item`` lines below a key, or ``[a, b]``), comments and quotes; other
YAML raises instead of being misread.  Lines are split, matched and gathered by Spark, so a folder may lie in any store that
Spark reads.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import shared_dir

KEY = r"^([A-Za-z_][A-Za-z0-9_]*)\s*:(?:\s+(.*))?$"
ITEM = r"^\s*-\s+(.*)$"
#: A line up to a ``#`` that begins it or follows a space, unless quoted.
NO_COMMENT = r"""^((?:"[^"]*"|'[^']*'|[^\s#]|\s+(?!#)|(?<=\S)#)*)"""

#: Columns of the two kinds of configuration.
COUNTRY_COLUMNS = {"first_year": "int", "last_year": "int", "first_full_cohort": "int", "first_data_age": "int",
                   "last_data_age": "int", "country": "string"}
MODEL_COLUMNS = {"model": "string", "param_func": "array<string>", "dispersion": "string", "minimum_age": "int",
                 "maximum_age": "int", "time_dimension": "string", "T_holdback": "int", "T_forecast": "int",
                 "n_dispersion_basis": "int", "first_freeze_age": "int", "last_freeze_age": "int"}


def _plain(text):
    """A scalar without its quotes; ``~``, ``null`` and nothing are null."""
    t = F.trim(text)
    bare = F.regexp_replace(t, r"""^(["'])(.*)\1$""", "$2")
    return F.when(~t.isin("", "~", "null"), bare)


def yaml_entries(files: DataFrame) -> DataFrame:
    """(name, key, values) of the top-level keys in ``files`` (name, value: a whole file)."""
    lines = files.select("name", F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.rtrim(F.regexp_extract("line", NO_COMMENT, 1))).filter("line <> '' and line <> '---'")
    key, item = F.regexp_extract("line", KEY, 1), F.regexp_extract("line", ITEM, 1)
    below = Window.partitionBy("name").orderBy("at")
    lines = lines.select("name", "at", "line", F.last(F.when(key != "", key), ignorenulls=True).over(below).alias("key"),
                         F.when(key != "", F.trim(F.regexp_extract("line", KEY, 2))).alias("value"), F.when(item != "", item).alias("item"))
    odd = F.col("value").isNull() & F.col("item").isNull() | F.col("key").isNull() | F.col("value").rlike(r"^[{&*|>!]")
    wrong = F.when(odd, F.raise_error(F.concat(F.lit("not understood in "), F.col("name"), F.lit(": "), F.col("line"))))
    inline = F.split(F.regexp_extract("value", r"^\[(.*)\]$", 1), r"\s*,\s*")
    values = F.when(F.col("item").isNotNull(), F.array("item")).when(F.col("value").rlike(r"^\[.*\]$"), inline).otherwise(F.array("value"))
    rows = lines.select("name", "at", F.coalesce(wrong.cast("string"), F.col("key")).alias("key"), F.posexplode(values).alias("n", "value"))
    listed = F.array_sort(F.collect_list(F.struct("at", "n", _plain(F.col("value")).alias("value"))))
    entries = rows.groupBy("name", "key").agg(listed.alias("v"))
    return entries.select("name", "key", F.filter(F.transform("v", lambda v: v["value"]), lambda v: v.isNotNull()).alias("values"))


def config_table(entries: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row per file: ``name`` and the given columns, null where a file has no such key; other keys are ignored."""
    def value(column: str, kind: str):
        of = F.max(F.when(F.col("key") == column, F.col("values")))
        return of if kind.startswith("array") else F.get(of, F.lit(0)).cast(kind)

    return entries.groupBy("name").agg(*[value(c, kind).alias(c) for c, kind in columns.items()])


def read_configs(spark: SparkSession, folder: str, columns: dict[str, str]) -> DataFrame:
    """The YAML files of a folder, by the files' names without their ending."""
    files = spark.read.option("pathGlobFilter", "*.y*ml").text(folder, wholetext=True)
    name = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.ya?ml$", 1))
    return config_table(yaml_entries(files.select(name.alias("name"), "value")), columns)


def land_configs(spark: SparkSession, kind: str) -> str:
    """The package's own configurations (``country`` or ``model``), put where executors can read them."""
    own = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "run_configs", kind)
    folder = shared_dir(spark, f"config-{kind}")
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in sorted(os.listdir(own)):
        fs.copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(os.path.join(own, name)),
                             spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
    return folder
