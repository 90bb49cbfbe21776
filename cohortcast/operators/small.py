"""Size-checked broadcast of small derived tables.

A table derived from the data (cells-level aggregates, observation tables,
exposure grids) is bounded by the model dimensions (countries x cohorts x ages),
not by the number of draws or input rows, but the bound is only *proven* after
it is materialised.  ``small_side`` checkpoints such a table into the shared
checkpoint directory (cutting its lineage, so a lost executor does not recompute
the upstream scan), counts it, and broadcasts it only under the row limit;
above the limit it is pinned as the build side of a shuffled hash join, so that the
exploded side is never broadcast on the strength of an estimate.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import app_id, ensure_checkpoint_dir

BROADCAST_ROW_LIMIT = 2_000_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    m = df.checkpoint(eager=True)
    n = m.count()
    return F.broadcast(m) if n <= max_rows else m.hint("shuffle_hash")


_MEMO: dict[tuple, DataFrame] = {}


def small_table(spark, key: tuple, build, max_rows: int = BROADCAST_ROW_LIMIT, broadcast: bool = True) -> DataFrame:
    """``small_side`` of ``build()`` materialised once per application and key (the same
    derived table serves every query of a session; data files are immutable inputs).

    ``broadcast=False`` for tables that are not a join side (e.g. the base of a
    generator): a broadcast hint would travel up through the generators and make the
    *expanded* side look hinted at the next join."""
    k = (app_id(spark), broadcast, *key)
    if k not in _MEMO:
        if broadcast:
            _MEMO[k] = small_side(build(), max_rows)
        else:
            ensure_checkpoint_dir(spark)
            _MEMO[k] = build().checkpoint(eager=True)
    return _MEMO[k]


def stored_table(spark, key: tuple, build, partition_by: str) -> DataFrame:
    """``build()`` written once per application and key as Parquet in the shared checkpoint folder, in one directory per
    value of ``partition_by`` (readers that filter on it skip the others), and read back."""
    k = (app_id(spark), "stored", *key)
    if k not in _MEMO:
        path = f"{ensure_checkpoint_dir(spark)}/stored-{key[0]}-{uuid.uuid4().hex}"
        df = build()
        df.write.partitionBy(partition_by).parquet(path)
        _MEMO[k] = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    return _MEMO[k]


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, .. in ``order`` over the whole table, without a task that sees it all.

    The rows are sorted by ranges and stored, so that both passes see the same partitions; a partition's numbers start after
    the counts of those before it (one number per partition passes the driver)."""
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(*order) if order else df
    stored = ranged.sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row"))
    stored = stored.checkpoint(eager=True)
    counts = {r["_part"]: r["n"] for r in stored.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, seen = [], 0
    for part in range(max(counts, default=-1) + 1):
        offsets.append(seen)
        seen += counts.get(part, 0)
    start = F.element_at(F.array(*[F.lit(n).cast("long") for n in offsets or [0]]), F.col("_part") + 1)
    place = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))  # the partition's number is in the bits above
    return stored.select(*df.columns, (start + place + F.lit(1)).alias(name))


def release() -> None:
    """Forget all tables kept so far (after the data behind them were rewritten, or to begin afresh)."""
    _MEMO.clear()
