"""Merkle manifest of a dataset: a digest of every row, one root per group and one of all, and each row's proof.

``H`` is the lowercase hex SHA-256 of its inputs, one after the other.  A leaf is H of the row's fields, each ``-`` if it
is null, else the number of its UTF-8 bytes, a colon and the value.  In each group the leaves stand in ascending order;
while there are several nodes, every ``fanout`` consecutive ones (the last run may be shorter, down to one) become their
H.  What remains is the group's subroot, and the subroots, ordered by group (null first, by bytes), make the root likewise.

Levels are built by a pivot of slots: conditional aggregates over the children of a parent spread them into ``fanout``
columns of each child's row.  The columns in a row hashed together are the parent; without the own slot's column they are
the siblings, which lengthen the row's path.  ``DEPTH`` levels are made at a time inside blocks of ``fanout ** DEPTH``
neighbours, which one shuffle brings together, so that a window never holds more rows than a block; the blocks' nodes then
climb on, as many at a time.  Rows are numbered by a range sort and the counts of its partitions, so no group has to
pass through one task, however large it is.

Null ids come first; rows of one id are ordered by their digest, and repeated rows are leaves of their own.  Texts are
hashed whole and stay where they are: only ids, groups and digests move.  An empty table has no rows and no root.  Input
columns that the caller doesn't keep are dropped; kept names that clash with an output are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.small import small_side
from .common import staged

FANOUT = 2
#: Levels that are built inside one block of neighbours.
DEPTH = 8
#: Tables of at most so many rows (of some 3 KB) are broadcast, others joined by a shuffle.
BROADCAST_ROWS = 20_000

#: A step of a path: the digests left and right of the own slot, each side joined.
PATH = "array<struct<left: string, right: string>>"
OUTPUTS = ("leaf", "subroot", "root", "path")


def digest(*inputs: Column) -> Column:
    """H of its inputs; none of them null."""
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def field(value: Column) -> Column:
    """A field as it goes into a leaf."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*fields: Column) -> Column:
    return digest(*map(field, fields))


def proof_of(path: Column) -> Column:
    """H of all siblings on a path, level by level, from left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: F.array(s["left"], s["right"]))), "").cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with the place ``pos`` of each row in its ``group_key``, by ``order``, and the number ``n`` of the group's
    rows; ``order`` must tell all rows apart that differ."""
    keys = ["group_key", *order]
    at = F.monotonically_increasing_id()
    rows = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", at), "numbered")
    part = F.shiftright("at", 33).alias("part")
    runs = rows.groupBy("group_key", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    group = Window.partitionBy("group_key")
    before = F.sum("here").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("group_key", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("here").over(group).alias("n"))
    rows = rows.withColumn("part", part).join(small_side(runs, BROADCAST_ROWS), ["group_key", "part"])
    return rows.withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("at", "part", "first", "before")


def climb(nodes: DataFrame, most: int, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """``nodes`` (group_key, pos, n, node and others) with the group's last node in ``node`` and the ``path`` that leads
    there; ``most`` is the largest ``n``."""
    size = fanout**depth
    block = F.floor(F.col("pos") / size)
    rows = nodes.withColumns({"block": block, "path": F.array().cast(PATH)}).repartition("group_key", "block")
    kept = rows.columns
    for level in range(depth):
        if most <= fanout**level:
            break
        slot = F.floor(F.col("pos") / fanout**level) % fanout
        parent = F.floor(F.col("pos") / fanout ** (level + 1))
        children = Window.partitionBy("group_key", "block", parent)
        slots = [f"slot_{j}" for j in range(fanout)]
        pivot = [F.max(F.when(slot == j, F.col("node"))).over(children).alias(s) for j, s in enumerate(slots)]
        rows = rows.select(*kept, *pivot)
        left = F.concat_ws("", *[F.when(slot > j, F.col(s)) for j, s in enumerate(slots)])
        right = F.concat_ws("", *[F.when(slot < j, F.col(s)) for j, s in enumerate(slots)])
        several = F.col("n") > fanout**level
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        rows = rows.select(
            *[c for c in kept if c not in ("node", "path")],
            F.when(several, F.sha2(F.concat_ws("", *slots).cast("binary"), 256)).otherwise(F.col("node")).alias("node"),
            F.when(several, F.concat("path", step)).otherwise(F.col("path")).alias("path")).select(*kept)
    if most <= size:
        return rows.drop("block")
    rows = staged(rows, "climbed")
    above = rows.groupBy("group_key", F.col("block").alias("pos")).agg(F.ceil(F.max("n") / size).alias("n"), F.max("node").alias("node"))
    above = climb(above, -(-most // size), fanout, depth)
    above = above.select("group_key", F.col("pos").alias("block"), F.col("node").alias("top"), F.col("path").alias("rest"))
    rows = rows.join(small_side(above, BROADCAST_ROWS), ["group_key", "block"])
    return rows.withColumns({"node": F.col("top"), "path": F.concat("path", "rest")}).drop("block", "top", "rest")


def _largest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("n")).first()[0] or 0


def manifest(docs: DataFrame, fields: list[str], group: str | None, order: str, keep: dict[str, Column] | None = None,
             fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """For each row its ``order`` column, the columns ``keep`` derives, leaf, subroot, root and path."""
    keep = keep or {}
    if clash := {*OUTPUTS, "group_key", "node", "pos", "n", "block", "at", "part", order} & {*keep} or {order} & {*OUTPUTS}:
        raise ValueError(f"these names are taken: {', '.join(sorted(clash))}")
    name = F.lit(None).cast("string") if group is None else F.col(group).cast("string")
    key = F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name))
    leaves = docs.select(key.alias("group_key"), F.col(order).alias("sorted_by"), leaf_of(*map(F.col, fields)).alias("leaf"),
                         *[c.alias(k) for k, c in keep.items()])
    leaves = numbered(staged(leaves, "leaves"), ["sorted_by", "leaf", *keep])
    rows = staged(climb(leaves.withColumn("node", F.col("leaf")), _largest(leaves), fanout, depth), "group-paths")
    subroots = rows.groupBy("group_key").agg(F.max("node").alias("node"))
    tops = numbered(subroots.select(F.lit("").alias("group_key"), F.col("group_key").alias("own"), "node"), ["own"])
    tops = climb(tops.withColumn("subroot", F.col("node")), _largest(tops), fanout, depth)
    tops = tops.select(F.col("own").alias("group_key"), "subroot", F.col("node").alias("root"), F.col("path").alias("rest"))
    rows = rows.join(small_side(tops, BROADCAST_ROWS), "group_key")
    return rows.select(F.col("sorted_by").alias(order), *keep, "leaf", "subroot", "root", F.concat("path", "rest").alias("path"))
