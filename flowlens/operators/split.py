"""Deterministic splits and samples (SPL-*): select, don't sort.

Order is ``md5(key || ':' || seed)`` - reproducible across partitionings and in
any SQL engine. A cut at a rank is a hash: counts by hash prefix find the prefix
that holds the rank, the rows of that prefix alone are ranked, and every row is
then compared with its group's cut hashes in one narrow pass. Whole rows are
never shuffled or sorted, whatever the size of a group; a NULL group is a group.
"""
from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, hash_order
from ..session import cut_lineage
from .ranking import null_safe_join, prefix_sums

PREFIX = 4  # hexadecimal digits of the hash: 65,536 prefixes a group
MOST_GROUPS = 20_000  # groups whose cuts are sent to all tasks; a join by group would give one task a whole group


def positions(df: DataFrame, key: Sequence[str], by: Sequence[str] = (), seed: int = 42,
              out: str = "__pos") -> DataFrame:
    """0-based position of each row within its ``by`` group in hash order (ties by key)."""
    d = df.withColumn("__h", hash_order(key, seed)).withColumn("__one", F.lit(1).cast("long"))
    return prefix_sums(d, list(by), ["__h", *key], ["__one"]).withColumnRenamed("__one_below", out).drop("__h", "__one")


def first_in_hash_order(df: DataFrame, key: Sequence[str], by: Sequence[str],
                        ranks: Sequence[Callable[[Column], Column]], seed: int = 42) -> DataFrame:
    """``df`` with one boolean ``__in<i>`` per rank: the row is among the first ranks[i](n) of its group
    of n rows. Rows with equal hashes that straddle a cut are told apart by their order in a
    window over just those rows."""
    by = list(by)
    gk = [col(b) for b in by]
    hashed = df.select(*gk, hash_order(key, seed).alias("__h")).withColumn("__p", F.substring("__h", 1, PREFIX))
    counts = cut_lineage(hashed.groupBy(*gk, "__p").agg(F.count(F.lit(1)).alias("__c")))
    over = Window.partitionBy(*gk)
    counts = (counts.withColumn("__n", F.sum("__c").over(over))
              .withColumn("__below", F.coalesce(F.sum("__c").over(over.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    wanted = counts.withColumn("__cut", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), r(F.col("__n")).cast("long").alias("rank")) for i, r in enumerate(ranks)])))
    hits = wanted.where((F.col("__cut.rank") >= F.col("__below")) & (F.col("__cut.rank") < F.col("__below") + F.col("__c"))).select(
        *gk, "__p", "__below", F.col("__cut.i").alias("__i"), F.col("__cut.rank").alias("__rank"))
    few = counts.select(*gk).distinct().count() <= MOST_GROUPS
    sent = F.broadcast if few else (lambda d: d)
    inside = null_safe_join(hashed, sent(hits), [*by, "__p"]).groupBy(*gk, "__i", "__rank", "__below", "__h").agg(F.count(F.lit(1)).alias("__t"))
    run = Window.partitionBy(*gk, "__i").orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("__at", F.col("__below") + F.coalesce(F.sum("__t").over(run), F.lit(0)))
    found = inside.where((F.col("__at") <= F.col("__rank")) & (F.col("__rank") < F.col("__at") + F.col("__t")))
    # one row per group: the cut hash (NULL: the whole group is in) and how many of its ties are in
    cut = lambda i: F.max(F.when(F.col("__i") == i, F.struct(F.col("__h"), (F.col("__rank") - F.col("__at")).alias("ties"))))
    cuts = found.groupBy(*gk).agg(*[cut(i).alias(f"__cut{i}") for i in range(len(ranks))])
    cuts = cut_lineage(cuts)
    # rows stay where they are if groups are few; of many groups, a join by group splits those that are large
    rows = null_safe_join(df.withColumn("__h", hash_order(key, seed)), sent(cuts), by, "left")
    straddled = cuts.agg(*[F.max(F.col(f"__cut{i}.ties")).alias(f"t{i}") for i in range(len(ranks))]).first()
    tied = any(t for t in straddled)

    def flags(d: DataFrame, place: Column) -> DataFrame:
        return d.select(*[col(c) for c in df.columns], *[
            (F.col(f"__cut{i}").isNull() | (F.col("__h") < F.col(f"__cut{i}.__h"))
             | ((F.col("__h") == F.col(f"__cut{i}.__h")) & (place < F.col(f"__cut{i}.ties")))).alias(f"__in{i}") for i in range(len(ranks))])

    if not tied:
        return flags(rows, F.lit(0))
    at_cut = F.coalesce(F.greatest(*[(F.col("__h") == F.col(f"__cut{i}.__h")).cast("int") for i in range(len(ranks))], F.lit(0)), F.lit(0)) == 1
    same = rows.where(at_cut).withColumn("__place", F.row_number().over(Window.partitionBy(*gk, "__h").orderBy(*[col(k) for k in key])) - 1)
    return flags(rows.where(~at_cut), F.lit(0)).unionByName(flags(same, F.col("__place")))


def stratified_split(df: DataFrame, label: str, key: Sequence[str], train: float = 0.70, val: float = 0.15,
                     test: float = 0.15, seed: int = 42, out: str = "split") -> DataFrame:
    """SPL-01: per class n_train = floor(n*train), n_val = floor(n*val), rest test.

    Rows with a NULL label are dropped (as a group-by split does).
    """
    if abs(train + val + test - 1.0) > 1e-9:
        raise ValueError(f"train, val and test must add up to 1, not {train + val + test}")
    d = df.where(col(label).isNotNull())
    n_train = lambda n: F.floor(n * F.lit(float(train)))
    n_both = lambda n: n_train(n) + F.floor(n * F.lit(float(val)))
    p = first_in_hash_order(d, key, [label], [n_train, n_both], seed)
    return p.withColumn(out, F.when(F.col("__in0"), "train").when(F.col("__in1"), "val").otherwise("test")).drop("__in0", "__in1")


def stratified_two_way(df: DataFrame, label: str, key: Sequence[str], test_size: float = 0.2, seed: int = 42,
                       out: str = "split") -> DataFrame:
    """SPL-02: per class floor(n*(1-test_size)) train rows, rest test."""
    return stratified_split(df, label, key, 1.0 - test_size, 0.0, test_size, seed, out) \
        .withColumn(out, F.when(F.col(out) == "val", "test").otherwise(F.col(out)))


def shuffled_prefix_split(df: DataFrame, key: Sequence[str], train: float = 0.8, seed: int = 42,
                          out: str = "split") -> DataFrame:
    """SPL-03: unstratified; the first floor(N*train) rows in hash order train, the rest test.

    The cut is one hash, not a global sort into one task.
    """
    p = first_in_hash_order(df, key, [], [lambda n: F.floor(n * F.lit(float(train)))], seed)
    return p.withColumn(out, F.when(F.col("__in0"), "train").otherwise("test")).drop("__in0")


def fixed_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """SPL-04: the n rows first in hash order (TakeOrdered: a bounded top-n per task)."""
    return df.withColumn("__h", hash_order(key, seed)).orderBy("__h", *[col(k) for k in key]).limit(n).drop("__h")


def stratified_cap(df: DataFrame, label: str, key: Sequence[str], cap: int, seed: int = 42) -> DataFrame:
    """SPL-05: at most ``cap`` rows in total, each class keeping floor(cap * share) rows.

    A NULL label is a class of its own, below the cap and above it."""
    total = df.count()
    share = min(1.0, cap / max(total, 1))
    p = first_in_hash_order(df, key, [label], [lambda n: F.floor(n * F.lit(share))], seed)
    return p.where("__in0").drop("__in0")


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """SPL-06: w_c = N / (K * N_c), joined onto rows (a NULL class has its own weight).

    N and K come from a window over the class-count table (one row per class)."""
    n = df.groupBy(col(label)).agg(F.count(F.lit(1)).alias("__nc"))
    every = Window.partitionBy()
    w = n.select(col(label), (F.sum("__nc").over(every) / (F.count(F.lit(1)).over(every) * F.col("__nc"))).alias(out))
    return null_safe_join(df, w, [label], "left")


def temporal_split(df: DataFrame, ts: str, train: float = 0.8, out: str = "split") -> DataFrame:
    """SPL-07: rows at or before the ``train`` percentile of time train; later rows test."""
    from .ranking import quantiles
    t = df.select(F.unix_micros(col(ts).cast("timestamp")).cast("double").alias("__t"))
    cut = quantiles(t, ["__t"], [train]).first()["q"]
    return df.withColumn(out, F.when(F.unix_micros(col(ts).cast("timestamp")) <= F.lit(cut), "train").otherwise("test"))


__all__ = ["positions", "stratified_split", "stratified_two_way", "shuffled_prefix_split", "fixed_sample",
           "stratified_cap", "class_weights", "temporal_split", "first_in_hash_order"]
