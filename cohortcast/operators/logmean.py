"""log(mean(exp(x))) per group, in one pass over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import lit_d

#: Width of a band: exp() of a value in units of its band's foot cannot overflow.
BAND = 64.0


def _add(top: Column):
    def add(total: Column, b: Column) -> Column:
        return total + F.when(b["_b"].isNull(), b["_s"]).otherwise(b["_s"] * F.exp((b["_b"] - top) * BAND))

    return add


def log_mean_exp(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """log(mean(exp(v))) per group for each of ``values``, and n_draws (rows of the group).

    Values are summed as exp(x - 64 b) per band b = floor(x / 64), by a partial aggregate before the shuffle; the few
    bands of a group are then added in units of the highest one.  Nothing is stored, joined back or run at plan time.
    -inf counts with weight zero; a group of nothing else gives -inf; NaN and +inf stay."""
    x = F.col("_x")
    rows = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("c"), v.alias("x")) for k, v in enumerate(values.values())))).alias("_v"))
    rows = rows.select(*keys, F.col("_v.c").alias("_c"), F.col("_v.x").cast("double").alias("_x"))
    low, odd = x == float("-inf"), (x == float("inf")) | F.isnan(x)
    band = F.when(~(low | odd), F.floor(x / BAND).cast("double"))
    rows = rows.withColumn("_b", band)
    weight = F.when(odd, x).when(low, lit_d(0.0)).otherwise(F.exp(x - F.col("_b") * BAND))
    bands = rows.groupBy(*keys, "_c", "_b").agg(F.sum(weight).alias("_s"), F.count(F.lit(1)).alias("_n"))

    def of(k: int) -> tuple[Column, Column, Column]:
        mine = F.col("_c") == k
        return (F.collect_list(F.when(mine, F.struct("_b", "_s"))).alias(f"_bands{k}"),
                F.max(F.when(mine, F.col("_b"))).alias(f"_top{k}"), F.sum(F.when(mine, F.col("_n"))).alias(f"_n{k}"))

    groups = bands.groupBy(*keys).agg(*(c for k in range(len(values)) for c in of(k)))
    out = []
    for k, name in enumerate(values):
        top = F.coalesce(F.col(f"_top{k}"), lit_d(0.0))

        total = F.aggregate(f"_bands{k}", lit_d(0.0), _add(top))
        out.append(F.when(total == 0.0, lit_d(float("-inf"))).otherwise(
            F.log(total) + top * BAND - F.log(F.col(f"_n{k}").cast("double"))).alias(name))
    return groups.select(*keys, *out, F.col("_n0").alias("n_draws"))
