"""Report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stack(frames: list[DataFrame], allow_missing: bool = False) -> DataFrame:
    """UNION ALL by column name (optionally filling missing columns with NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def labelled(df: DataFrame, method: str, value_cols: dict[str, str]) -> DataFrame:
    """One method's per-country figures renamed to the report's common columns."""
    return df.select(F.lit(method).alias("Method"), "Country", *[F.col(src).alias(dst) for dst, src in value_cols.items()])


def pivot_countries(long: DataFrame, value: str, countries: tuple[str, ...], row_key: str = "Method") -> DataFrame:
    """H4: one column for each configured country."""
    return long.groupBy(row_key).pivot("Country", list(countries)).agg(F.first(value))


def best_per_country(long: DataFrame, value: str, digits: int = 4) -> DataFrame:
    """P2 (D29, F3, I21): rounded value (half-even) and a flag on the smallest value per country."""
    w = Window.partitionBy("Country")
    return long.select(
        "Method", "Country", value,
        F.bround(F.col(value), digits).alias(f"{value}_rounded"),
        (F.col(value) == F.min(value).over(w)).alias("best"),
    )


def short_density(col):
    """I16: drop the ``_density`` suffix."""
    return F.regexp_replace(col, "_density", "")


def components_label(p1, p2):
    """M12 / I17: 'Gamma / Weibull' style label."""
    return F.concat_ws(" / ", F.initcap(short_density(p1)), F.initcap(short_density(p2)))


def looic_grid(looic: DataFrame) -> DataFrame:
    """LOOIC of every (first component, second component) pair; second component as columns."""
    g = looic.select("Country", short_density(F.col("p1")).alias("first"), short_density(F.col("p2")).alias("second"),
                     "looic")
    return g.groupBy("Country", "first").pivot("second", ["gamma", "weibull", "hadwiger"]).agg(F.first("looic"))
