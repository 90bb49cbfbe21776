"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for each vertex of ``edges`` (a, b: of one orderable type); the component is its least vertex.

    Each round hangs every neighbour of a vertex onto the least one, first the larger neighbours and then the smaller
    ones, until nothing changes.  Minima are partial aggregates; the join back to a vertex of very many edges is one
    that Spark can split, as both of its sides come from the checkpoint folder.  Loops and repeated edges are allowed.
    """
    ensure_checkpoint_dir(edges.sparkSession)

    def settled(df: DataFrame) -> DataFrame:
        return df.filter("a <> b").distinct().checkpoint()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = settled(edges.select("a", "b"))
    before, now = None, mark(edges)
    while now != before and now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).checkpoint()
        large = settled(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m")).checkpoint()
        hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settled(hung.unionByName(least.select("a", F.col("m").alias("b"))))
        before, now = now, mark(edges)
    roots = edges.select(F.col("b").alias("vertex")).distinct()
    return (edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
            .unionByName(roots.select("vertex", F.col("vertex").alias("component"))))
