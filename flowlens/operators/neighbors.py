"""Neighbours in sorted order across task borders, and the mutual information that is estimated from them.

``neighbours`` deals rows by range, and copies the rows at the edges of a range to the ranges beside it
(a halo), so every row sees its ``k`` neighbours on either side although no group is ever sorted in one task.
"""
from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, finite
from ..session import cut_lineage
from .ranking import long_values, prefix_sums

GRID_BITS = 40  # values are compared on a grid of 2^-40 of the power of two above the feature's largest magnitude


def neighbours(df: DataFrame, keys: Sequence[str], order: str, k: int, carry: Sequence[str] = ()) -> DataFrame:
    """Adds ``before`` and ``after``: up to ``k`` structs (``order``, *carry) of the rows that precede and follow within the key group.

    The order must be total within a group. Keys must not be NULL. The dealt rows are written once; a range
    that holds fewer than ``k`` rows of a group takes the rest of its halo from the ranges beyond."""
    keys, own = list(keys), df.columns
    gk = [col(c) for c in keys]
    dealt = cut_lineage(df.repartitionByRange(*gk, col(order)).withColumn("__pid", F.spark_partition_id()))
    here = Window.partitionBy(*gk, "__pid")

    def halo(descending: bool) -> DataFrame:
        """Edge rows of ranges, given to the ranges after them (tails) or before them (heads)."""
        key = F.desc(order) if descending else F.asc(order)
        edge = dealt.withColumn("__at", F.row_number().over(here.orderBy(key))).where(F.col("__at") <= k).drop("__at")
        # at most k rows of a range: this table grows with the number of tasks, not of rows
        placed = edge.withColumn("__rn", F.row_number().over(Window.partitionBy(*gk).orderBy(F.asc(order) if descending else F.desc(order))))
        spans = placed.groupBy(*gk, "__pid").agg(F.min("__rn").alias("__first"))
        wanted = spans.where("__first > 1").select(*gk, F.col("__pid").alias("__to"), F.explode(
            F.sequence(F.greatest(F.lit(1), F.col("__first") - k), F.col("__first") - 1)).alias("__rn"))
        return placed.drop("__pid").join(wanted, [*keys, "__rn"]).withColumnRenamed("__to", "__pid").drop("__rn")

    mark = lambda d, flag: d.select(*[col(c) for c in own], "__pid", F.lit(flag).alias("__halo"))
    everything = mark(dealt, False).unionByName(mark(halo(True), True)).unionByName(mark(halo(False), True))
    item = F.struct(col(order), *[col(c) for c in carry])
    near = here.orderBy(order)
    out = everything.withColumn("before", F.collect_list(item).over(near.rowsBetween(-k, -1))).withColumn("after", F.collect_list(item).over(near.rowsBetween(1, k)))
    return out.where(~F.col("__halo")).select(*[col(c) for c in own], "before", "after")


def digamma(x: Column) -> Column:
    """The digamma function for x >= 1: recurrence to x + 6, then the asymptotic series (error below 1e-12)."""
    y = x + 6.0
    shift = sum((1.0 / (x + float(i)) for i in range(1, 6)), 1.0 / x)
    inv = 1.0 / (y * y)
    series = F.log(y) - 0.5 / y - inv * (1.0 / 12 - inv * (1.0 / 120 - inv * (1.0 / 252 - inv * (1.0 / 240 - inv / 132))))
    return series - shift


def grid_scale(largest: float | None) -> float:
    """Power of two that takes values up to ``largest`` to integers below 2^GRID_BITS."""
    return 2.0 ** (GRID_BITS - math.ceil(math.log2(largest))) if largest else 1.0


def neighbour_mutual_information(df: DataFrame, features: Sequence[str], label: str, k: int = 3) -> DataFrame:
    """Mutual information (nats) between each continuous feature and a discrete label, by nearest neighbours.

    For a row, r is the distance to its k-th nearest row of the same class and m the number of rows of any class that
    are nearer than r (itself included; with r = 0, those that are equal). The estimate is
    psi(N) + mean psi(k) - mean psi(class size) - mean psi(m), at least 0; a class of one row is left out, and a
    smaller class uses its size less one for k.

    Returns (feature, mutual_info). NULL, NaN and infinite values and NULL labels are left out by feature. Equal values are one
    row with a count throughout, so a value that a third of the rows hold weighs nothing."""
    fs = list(features)
    clean = df.select(*[finite(col(f)).alias(f) for f in fs], col(label).cast("string").alias("__y")).where(F.col("__y").isNotNull())
    tops = clean.agg(*[F.max(F.abs(col(f))).alias(f"m{i}") for i, f in enumerate(fs)]).first()
    grid = clean.select("__y", *[F.floor(col(f) * F.lit(grid_scale(tops[f"m{i}"])) + F.lit(0.5)).cast("double").alias(f) for i, f in enumerate(fs)])
    values = long_values(grid, fs, extra=["__y"]).groupBy("feature", "__y", F.col("value").cast("bigint").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    values = cut_lineage(values)
    classes = values.groupBy("feature", "__y").agg(F.sum("c").alias("size")).where("size > 1")
    near = neighbours(values, ["feature", "__y"], "v", k, ["c"]).join(classes, ["feature", "__y"])

    step = lambda d, c: F.struct(d.alias("d"), c.alias("c"))
    around = F.concat(F.array(step(F.lit(0).cast("bigint"), F.col("c") - 1)), F.transform("before", lambda x: step(F.col("v") - x["v"], x["c"])),
                      F.transform("after", lambda x: step(x["v"] - F.col("v"), x["c"])))
    use = F.least(F.lit(k).cast("bigint"), F.col("size") - 1)
    none = F.lit(None).cast("bigint")
    found = F.aggregate(F.array_sort(around), F.struct(F.lit(0).cast("bigint").alias("seen"), none.alias("r")), lambda acc, x: F.struct(
        (acc["seen"] + x["c"]).alias("seen"), F.coalesce(acc["r"], F.when(acc["seen"] + x["c"] >= use, x["d"])).alias("r")))
    reach = F.greatest(found["r"] - 1, F.lit(0).cast("bigint"))  # nearer than r, on a grid of integers
    rows = cut_lineage(near.select("feature", "__y", "v", "c", "size", use.alias("k"), reach.alias("reach")))

    # how many values lie within reach: values and the two ends of each interval in one order, then prefix sums
    zero = F.lit(0).cast("bigint")
    marks = (rows.groupBy("feature", "v").agg(F.sum("c").alias("w")).select("feature", F.col("v").alias("at"), F.lit(1).alias("kind"), F.lit("").alias("y"), "v", "w")
             .unionByName(rows.select("feature", (F.col("v") - F.col("reach")).alias("at"), F.lit(0).alias("kind"), F.col("__y").alias("y"), "v", zero.alias("w")))
             .unionByName(rows.select("feature", (F.col("v") + F.col("reach")).alias("at"), F.lit(2).alias("kind"), F.col("__y").alias("y"), "v", zero.alias("w"))))
    placed = prefix_sums(marks, ["feature"], ["at", "kind", "y", "v"], ["w"]).where("kind <> 1")
    within = placed.groupBy("feature", F.col("y").alias("__y"), "v").agg(F.sum(F.when(F.col("kind") == 2, F.col("w_below")).otherwise(-F.col("w_below"))).alias("m"))
    psi = lambda c: digamma(F.col(c).cast("double"))
    total = F.sum("c").cast("double")
    mean = lambda c: F.sum(F.col("c") * psi(c)) / total
    info = rows.join(within, ["feature", "__y", "v"]).groupBy("feature").agg((digamma(total) + mean("k") - mean("size") - mean("m")).alias("mi"))
    return info.select("feature", F.greatest("mi", F.lit(0.0)).alias("mutual_info"))
