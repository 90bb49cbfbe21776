"""Empirical rates and simple totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ieee_div

CELL_KEYS = ["Country", "Year", "Age", "Cohort"]


def harmonise_headers(df: DataFrame) -> DataFrame:
    """A4: ``Total`` -> ``Births`` and ``ARDY`` -> ``Age``, only where present."""
    if "Total" in df.columns and "Births" not in df.columns:
        df = df.withColumnRenamed("Total", "Births")
    if "ARDY" in df.columns and "Age" not in df.columns:
        df = df.withColumnRenamed("ARDY", "Age")
    return df


def empirical_rates(expos: DataFrame, births: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """C1 + B9: exposure LEFT JOIN births on the shared cell keys, Rate = Births / Exposure.

    ``OpenInterval`` is dropped from both sides; keys are explicit (the reference joins
    naturally on whatever columns coincide)."""
    expos, births = harmonise_headers(expos), harmonise_headers(births)
    if keys is None:
        keys = [k for k in CELL_KEYS if k in expos.columns and k in births.columns]
    e = expos.drop("OpenInterval")
    b = births.drop("OpenInterval").select(*keys, "Births")
    return e.join(b, keys, "left").withColumn("Rate", ieee_div(F.col("Births"), F.col("Exposure")))


def cell_rates(cells: DataFrame) -> DataFrame:
    """B9 when births and exposure already share a row (one aggregate, no self-join)."""
    return cells.withColumn("Rate", ieee_div(F.col("Births"), F.col("Exposure")))


def clamp_age(age, first_age: int, last_age: int):
    """B1: ages below/above the observed range are folded into the edge ages."""
    return F.greatest(F.least(age, F.lit(last_age)), F.lit(first_age))


def births_clamped(births: DataFrame, axis: str, first_age: int, last_age: int) -> DataFrame:
    """B1 + D1: clamp age then sum births by (Country, axis, Age)."""
    return (
        births.withColumn("Age", clamp_age(F.col("Age"), first_age, last_age))
        .groupBy("Country", axis, "Age")
        .agg(F.sum("Births").alias("Births"))
    )


def completed_family_size(rates: DataFrame, axis: str = "Cohort") -> DataFrame:
    """Cohort (CFS) or period (TFR) total of age-specific rates."""
    name = "CFS" if axis == "Cohort" else "TFR"
    return rates.groupBy("Country", axis).agg(
        F.sum("Rate").alias(name), F.count(F.lit(1)).alias("n_ages")
    )


def lexis_shapes(triangles: DataFrame) -> DataFrame:
    """A3: births and exposure in both Lexis shapes, one below the other: (lexis, Country, Year, Age, Cohort, Births,
    Exposure).

    ``VV`` are the parallelograms of a cohort in a year, by the age reached in it.  ``RR`` are the squares of a completed age
    in a year, without a cohort: a woman has completed the age reached after her birthday and one year less before."""
    shapes = F.explode(F.array(
        F.struct(F.lit("VV").alias("lexis"), F.col("Age").alias("Age"), F.col("Cohort").alias("Cohort")),
        F.struct(F.lit("RR").alias("lexis"), F.when(F.col("after"), F.col("Age")).otherwise(F.col("Age") - 1).alias("Age"),
                 F.lit(None).cast("int").alias("Cohort"))))
    rows = triangles.select("Country", "Year", "Births", "Exposure", shapes.alias("s"))
    return rows.groupBy(F.col("s.lexis").alias("lexis"), "Country", "Year", F.col("s.Age").alias("Age"), F.col("s.Cohort").alias("Cohort")).agg(
        F.sum("Births").alias("Births"), F.sum("Exposure").alias("Exposure"))
