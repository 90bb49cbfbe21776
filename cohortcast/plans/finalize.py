"""Output normalisation shared by the Spark queries and their SQL oracles.

Floating-point sums depend on summation order and the math libraries of the two
engines differ in the last bit, so every registered query rounds its double
columns at the very end (Spark ``round`` / SQL ``round``) to a fixed number of
decimals.  Operators themselves return full precision; only the registered
query outputs are rounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

DEFAULT_DIGITS = 6


def finalize(df: DataFrame, digits: int = DEFAULT_DIGITS, overrides: dict[str, int] | None = None) -> DataFrame:
    overrides = overrides or {}
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            d = overrides.get(f.name, digits)
            cols.append((F.round(F.col(f.name).cast("double"), d) + F.lit(0.0)).alias(f.name))  # + 0.0: no -0.0
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def sql_round(select_sql: str, double_cols: list[str], digits: int = DEFAULT_DIGITS,
              overrides: dict[str, int] | None = None) -> str:
    """Wrap a SELECT so the listed double columns are rounded like ``finalize``."""
    overrides = overrides or {}
    rounded = ", ".join(f'(round("{c}", {overrides.get(c, digits)}) + 0.0e0) AS "{c}"' for c in double_cols)
    excl = ", ".join(f'"{c}"' for c in double_cols)
    if not double_cols:
        return select_sql
    return f"SELECT * EXCLUDE ({excl}), {rounded} FROM ({select_sql}) q"
