"""Folds of left-out points that keep near points apart (M7), and each point's nearest neighbour (C17).

Left-out points lie on the integer lattice of (time, age).  Distances are looked up ring by ring: the lattice is cut into
cells as wide as a ring's radius, and a point meets the run's points in its own cell and those around it.  So near pairs
are found without comparing all points of a run, and a wider ring is asked only for what is still open.

Splits are numbered.  Split 0 deals the points in turn; split k deals them in the order of an integer hash of point and k,
which any engine can repeat.  A split is as good as its least distance within a fold, and of equally good ones the first
counts.  Runs of up to ``n_folds`` points have a fold for each and no least distance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N_FOLDS = 3
N_SPLITS = 101
#: Folds whose points come nearer than this are flagged.
NEAR = 2.0

PRIME = 2_147_483_647


def split_hash(i: Column, split: Column) -> Column:
    """Order of the points in a split: a product of the point with the split's own multiplier, stirred once more."""
    i, split = i.cast("bigint"), split.cast("bigint")
    own = (split * F.lit(69621) + F.lit(48271)) * F.lit(40014) % F.lit(PRIME)
    return (i * own % F.lit(PRIME)) * (i + split) % F.lit(PRIME)


def ring(points: DataFrame, others: DataFrame, keys: list[str], inner: int, outer: int) -> DataFrame:
    """(keys, i, j, d2) of each of ``points`` with each other one of ``others`` at a distance beyond ``inner`` (0: any) and
    up to ``outer``."""
    around = [F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias(c) for c in ("dx", "dy")]
    cell = lambda c: F.floor(F.col(c) / outer)
    at = points.select(*keys, "i", "Time", "Age_i", around[0]).select("*", around[1])
    at = at.select(*keys, "i", "Time", "Age_i", (cell("Time") + F.col("dx")).alias("x"), (cell("Age_i") + F.col("dy")).alias("y"))
    there = others.select(*keys, F.col("i").alias("j"), F.col("Time").alias("t"), F.col("Age_i").alias("a"), cell("Time").alias("x"), cell("Age_i").alias("y"))
    dt, da = F.col("Time") - F.col("t"), F.col("Age_i") - F.col("a")
    near = at.join(there, [*keys, "x", "y"]).filter("i <> j").select(*keys, "i", "j", (dt * dt + da * da).alias("d2"))
    return near.filter((F.col("d2") <= outer * outer) & (F.col("d2") > (inner * inner if inner else -1)))


def rings(points: DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    """Radii, each four times the last, up to the widest run."""
    spread = points.groupBy(*keys).agg((F.max("Time") - F.min("Time") + F.max("Age_i") - F.min("Age_i")).alias("w"))
    widest = spread.agg(F.max("w")).first()[0] or 0
    radii = [0, 2]
    while radii[-1] < widest:
        radii.append(radii[-1] * 4)
    return list(zip(radii, radii[1:], strict=False))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def nearest(points: DataFrame, keys: tuple[str, ...] = ("Country",)) -> DataFrame:
    """C17: (keys, i, nn_dist): distance of every point to the nearest other one of its run; null for a run's only one."""
    k = list(keys)
    points = points.select(*k, "i", "Time", "Age_i").checkpoint()
    left, found = points, []
    for inner, outer in rings(points, k):
        near = ring(left, points, k, inner, outer).groupBy(*k, "i").agg(F.min("d2").alias("d2")).checkpoint()
        found.append(near)
        left = left.join(near, [*k, "i"], "left_anti").checkpoint()
        if left.isEmpty():
            break
    return points.select(*k, "i").join(_union(found), [*k, "i"], "left").select(*k, "i", F.sqrt(F.col("d2").cast("double")).alias("nn_dist"))


def splits(points: DataFrame, keys: list[str], n_folds: int, n_splits: int) -> DataFrame:
    """(keys, i, split, fold): balanced folds of every split, of the runs with more points than folds."""
    run = Window.partitionBy(*keys)
    many = points.withColumn("n", F.count(F.lit(1)).over(run)).filter(F.col("n") > n_folds)
    dealt = many.select(*keys, "i", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("split"))
    order = F.when(F.col("split") == 0, F.lit(0)).otherwise(split_hash(F.col("i"), F.col("split")))
    place = F.row_number().over(Window.partitionBy(*keys, "split").orderBy(order, "i"))
    return dealt.select(*keys, "i", "split", ((place - 1) % n_folds + 1).cast("int").alias("fold"))


def best_folds(points: DataFrame, keys: tuple[str, ...] = ("Country",), n_folds: int = N_FOLDS, n_splits: int = N_SPLITS) -> DataFrame:
    """M7: (keys, i, fold, min_within_dist, too_near) of the split whose folds keep their points farthest apart."""
    k = list(keys)
    points = points.select(*k, "i", "Time", "Age_i").checkpoint()
    dealt = splits(points, k, n_folds, n_splits).checkpoint()
    open_runs = dealt.select(*k).distinct().checkpoint()
    scores = []
    for inner, outer in rings(points, k):
        pairs = ring(points.join(open_runs, k, "left_semi"), points, k, inner, outer).filter("i < j")
        same = pairs.join(dealt, [*k, "i"]).join(
            dealt.select(*k, F.col("i").alias("j"), "split", "fold"), [*k, "j", "split", "fold"])
        scores.append(same.groupBy(*k, "split").agg(F.min("d2").alias("d2")).checkpoint())
        known = _union(scores).select(*k, "split").distinct().groupBy(*k).agg(F.count(F.lit(1)).alias("n"))
        open_runs = open_runs.join(known.filter(F.col("n") == n_splits), k, "left_anti").checkpoint()
        if open_runs.isEmpty():
            break
    if not scores:
        scores = [dealt.select(*k, "split", F.lit(0).alias("d2"))]  # no run of two points or more
    least = _union(scores).groupBy(*k, "split").agg(F.min("d2").alias("d2"))
    best = least.groupBy(*k).agg(F.max(F.struct("d2", (-F.col("split")).alias("first"))).alias("b"))
    best = best.select(*k, F.sqrt(F.col("b.d2").cast("double")).alias("min_within_dist"), (-F.col("b.first")).alias("split"))
    chosen = dealt.join(best, [*k, "split"]).select(*k, "i", "fold", "min_within_dist")
    few = points.join(chosen.select(*k).distinct(), k, "left_anti")
    single = few.select(*k, "i", F.row_number().over(Window.partitionBy(*k).orderBy("i")).alias("fold"), F.lit(None).cast("double").alias("min_within_dist"))
    return chosen.unionByName(single).withColumn("too_near", F.coalesce(F.col("min_within_dist") < NEAR, F.lit(False)))
