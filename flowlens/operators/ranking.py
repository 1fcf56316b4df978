"""Order statistics without a single-task window, one path for every size.

A window with only ``orderBy`` (or one partition per feature) sends every
distinct value of a column to one task. At 100 TB that is unbounded, so every
rank-based operator here (exact quantiles, Mann-Whitney AUC, cumulative PR
curves) goes through :func:`prefix_sums`:

1. Rows are dealt by range of the whole (group, order) key, so a large group, or one
   whose values share a long prefix, spreads over as many tasks as it needs.
2. Each task's sums by group give a table of (group, task) offsets.
3. A window over (group, task) finishes the scan; each task holds one range.

Inputs are pre-aggregated to one row per distinct (group, value) first, so a hot
value that holds a third of all rows is a single row with a large count. A NULL
group is a group like any other.
"""
from __future__ import annotations

import math
from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import cut_lineage

SKETCH_ACCURACY = 20000
MOST_SENT = 20_000  # rows of a table that is sent to all tasks


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the key columns of ``left`` stay."""
    keys = list(keys)
    if not keys:
        return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    named = right.select(*[col(k).alias(f"__r_{i}") for i, k in enumerate(keys)],
                         *[col(c) for c in right.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [col(k).eqNullSafe(F.col(f"__r_{i}")) for i, k in enumerate(keys)])
    return left.join(named, on, how).drop(*[f"__r_{i}" for i in range(len(keys))])


def sent_if_few(table: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """``table`` marked for a broadcast if it has at most ``most`` rows, counted by a job.

    For joins of rows with a table of groups, labels or codes: joined by a few keys, one task would get all rows of a key."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def prefix_sums(df: DataFrame, keys: Sequence[str], order_col: str | Sequence[str], sum_cols: Sequence[str]) -> DataFrame:
    """Add ``<c>_below`` = sum of ``c`` over rows of the same key group that sort
    strictly before the row. ``order_col`` is one column or a compound order.
    The order must be total within a group (pre-aggregate or add a key).
    ``keys`` may be empty for one global order.

    The dealt rows are written once (checkpoint folder): both steps must see the same ranges.
    """
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    own = df.columns
    keys = list(keys)
    if not keys:
        df = df.withColumn("__g", F.lit(0))
        keys = ["__g"]
    gk = [col(k) for k in keys]
    dealt = df.repartitionByRange(*gk, *[col(c) for c in order]).withColumn("__pid", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    tot = dealt.groupBy(*gk, "__pid").agg(*[F.sum(col(c)).alias(f"__t_{c}") for c in sum_cols])
    wb = Window.partitionBy(*gk).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*gk, "__pid",
                      *[F.coalesce(F.sum(f"__t_{c}").over(wb), F.lit(0)).alias(f"__o_{c}") for c in sum_cols])
    wi = (Window.partitionBy(*gk, "__pid").orderBy(*[col(c) for c in order])
          .rowsBetween(Window.unboundedPreceding, -1))
    out = null_safe_join(dealt, offs, [*keys, "__pid"])
    for c in sum_cols:
        out = out.withColumn(f"{c}_below", F.col(f"__o_{c}") + F.coalesce(F.sum(col(c)).over(wi), F.lit(0)))
    return out.select(*[col(c) for c in own], *[col(f"{c}_below") for c in sum_cols])


def rank_distinct(df: DataFrame, keys: Sequence[str], value: str, out: str = "code") -> DataFrame:
    """Distinct ``value`` per key group with its 0-based position in sorted order.

    Built on the prefix scan over the whole value, so a column with billions of distinct
    values, or values with a long common prefix, is ranked by many tasks.
    """
    keys = list(keys)
    d = df.select(*[col(k) for k in keys], col(value)).where(col(value).isNotNull()).distinct()
    r = prefix_sums(d.withColumn("__one", F.lit(1)), keys, value, ["__one"])
    return r.select(*[col(k) for k in keys], col(value), F.col("__one_below").cast("bigint").alias(out))


def long_values(df: DataFrame, features: Sequence[str], value_name: str = "value",
                extra: Sequence[str] = ()) -> DataFrame:
    """Unpivot feature columns to (extra..., feature, value) as double, NULLs dropped."""
    stacked = df.select(*[col(e) for e in extra],
                        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                                     col(f).cast("double").alias(value_name))
                                            for f in features])).alias("__kv"))
    return (stacked.select(*[col(e) for e in extra], "__kv.feature", f"__kv.{value_name}")
            .where(F.col(value_name).isNotNull()))


def value_counts_long(long_df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Distinct (keys, value) with multiplicity; partial aggregation runs map-side."""
    return long_df.groupBy(*[col(k) for k in keys], col(value)).agg(F.count(F.lit(1)).alias("cnt"))


def exact_quantiles_long(long_df: DataFrame, keys: Sequence[str], probs: Iterable[float],
                         value: str = "value") -> DataFrame:
    """Exact quantiles with linear interpolation (pandas / SQL ``percentile``)
    per key group -> (keys..., p, q), by the prefix scan over distinct values."""
    keys = list(keys)
    probs = list(probs)
    vc = prefix_sums(value_counts_long(long_df, keys, value), keys, value, ["cnt"]).withColumnRenamed("cnt_below", "below")
    n = vc.groupBy(*[col(k) for k in keys]).agg(F.sum("cnt").alias("__n"))
    targets = n.select(*[col(k) for k in keys], F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"), "__n")
    targets = targets.withColumn("__h", (F.col("__n") - 1) * F.col("p"))
    targets = targets.select(*[col(k) for k in keys], "p", "__h",
                             F.explode(F.array(
                                 F.struct(F.lit("lo").alias("role"), F.floor("__h").alias("pos")),
                                 F.struct(F.lit("hi").alias("role"), F.ceil("__h").alias("pos")))).alias("__t"))
    targets = targets.select(*[col(k) for k in keys], "p", "__h", "__t.role", "__t.pos")
    hit = null_safe_join(vc, targets, keys).where(
        (F.col("pos") >= F.col("below")) & (F.col("pos") < F.col("below") + F.col("cnt")))
    per = hit.groupBy(*[col(k) for k in keys], "p").agg(
        F.first("__h").alias("__h"),
        F.max(F.when(F.col("role") == "lo", col(value))).alias("__lo"),
        F.max(F.when(F.col("role") == "hi", col(value))).alias("__hi"))
    frac = F.col("__h") - F.floor("__h")
    return per.select(*[col(k) for k in keys], "p",
                      (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * frac).alias("q"))


def select_quantiles(df: DataFrame, features: Sequence[str], probs: Sequence[float], accuracy: int = 2_000,
                     most: int = 200_000) -> list[tuple[str, float, float]]:
    """Exact quantiles (linear interpolation) of many columns by rank selection: (feature, p, q) rows.

    No value is shuffled but the last few. A round is one aggregate over all columns: sketches give each wanted rank a bracket
    of values, and exact counts below and inside the brackets check it (a bracket that misses its rank is opened on that side).
    Brackets shrink by a factor of about ``accuracy`` / 5 a round, until together they hold at most ``most`` rows; those are grouped by value and
    the ranks are read off. A bracket that ties keep from shrinking is left to the prefix scan."""
    fs, ps = list(features), [float(p) for p in probs]
    values = df.select(*[col(f).cast("double").alias(f"x{i}") for i, f in enumerate(fs)])
    lowest, highest = float("-inf"), float("inf")
    inside = lambda i, a, b: (F.col(f"x{i}") >= F.lit(a)) & (F.col(f"x{i}") <= F.lit(b))
    margin = 2.5 / accuracy

    def sketched(wanted):
        """(i, a, b, low share, high share) -> values at the shares among the values of [a, b], one aggregate for all."""
        row = values.agg(*[F.percentile_approx(F.when(inside(i, a, b), F.col(f"x{i}")), [min(1.0, max(0.0, u)), min(1.0, max(0.0, v))], accuracy).alias(f"s{k}")
                           for k, (i, a, b, u, v) in enumerate(wanted)]).first()
        return [(a if u <= 0 else row[f"s{k}"][0], b if v >= 1 else row[f"s{k}"][1]) for k, (i, a, b, u, v) in enumerate(wanted)]

    sizes = values.agg(*[F.count(f"x{i}").alias(f"n{i}") for i in range(len(fs))], *[
        F.percentile_approx(f"x{i}", [max(0.0, min(1.0, p + s * margin)) for p in ps for s in (-1, 1)], accuracy).alias(f"s{i}") for i in range(len(fs))]).first()
    ranks: dict[tuple[int, float], tuple[int, int, float]] = {}
    bracket: dict[tuple[int, float], tuple[float, float]] = {}
    for i in range(len(fs)):
        n = sizes[f"n{i}"]
        for j, p in enumerate(ps) if n else ():
            h = (n - 1) * p
            ranks[i, p] = math.floor(h), math.ceil(h), h - math.floor(h)
            a, b = sizes[f"s{i}"][2 * j:2 * j + 2]
            bracket[i, p] = (lowest if p - margin <= 0 else a, highest if p + margin >= 1 else b)
    found: dict[tuple[int, float], float] = {}
    tied: set[tuple[int, float]] = set()
    while True:
        open_ = [k for k in ranks if k not in found and k not in tied]
        if not open_:
            break
        row = values.agg(*[e for k, (i, p) in enumerate(open_) for e in (
            F.count(F.when(F.col(f"x{i}") < F.lit(bracket[i, p][0]), 1)).alias(f"below{k}"), F.count(F.when(inside(i, *bracket[i, p]), 1)).alias(f"in{k}"))]).first()
        counted, settled = {}, True
        for k, key in enumerate(open_):
            below, size, (lo, hi, _), (a, b) = row[f"below{k}"], row[f"in{k}"], ranks[key], bracket[key]
            counted[key] = below, size
            if below > lo or below + size <= hi:
                bracket[key] = (lowest if below > lo else a, highest if below + size <= hi else b)
                settled = False
            elif a == b:
                found[key] = a
        if not settled:
            continue
        open_ = [k for k in open_ if k not in found]
        if sum(counted[k][1] for k in open_) <= most:
            break
        wide = [k for k in open_ if counted[k][1] > most // max(1, len(open_))]
        shares = [(k[0], *bracket[k], (ranks[k][0] - counted[k][0]) / counted[k][1] - margin, (ranks[k][1] - counted[k][0] + 1) / counted[k][1] + margin) for k in wide]
        for k, new in zip(wide, sketched(shares)):
            if new == bracket[k]:
                tied.add(k)
            bracket[k] = new
    open_ = [k for k in ranks if k not in found and k not in tied]
    if open_:
        entry = [F.when(inside(i, *bracket[i, p]), F.struct(F.lit(k).alias("k"), F.col(f"x{i}").alias("v"))) for k, (i, p) in enumerate(open_)]
        held = values.select(F.explode(F.array_compact(F.array(*entry))).alias("e")).groupBy("e.k", "e.v").agg(F.count(F.lit(1)).alias("c")).collect()  # at most ``most`` rows
        for k, key in enumerate(open_):
            lo, hi, part = ranks[key]
            at, picked = counted[key][0], {}
            for v, c in sorted((r["v"], r["c"]) for r in held if r["k"] == k):
                for want in (lo, hi):
                    if at <= want < at + c:
                        picked[want] = v
                at += c
            found[key] = picked[lo] + (picked[hi] - picked[lo]) * part
    for i, p in tied:
        rest = long_values(df, [fs[i]])
        found[i, p] = exact_quantiles_long(rest, ["feature"], [p]).first()["q"]
    return [(fs[i], p, q) for (i, p), q in found.items()]


def quantiles(df: DataFrame, features: Sequence[str], probs: Sequence[float], method: str = "exact",
              by: Sequence[str] = ()) -> DataFrame:
    """Per-feature quantiles -> long (by..., feature, p, q).

    method: ``exact`` (rank selection; by groups the prefix scan; same numbers as SQL percentile), ``builtin`` (Spark
    ``percentile``: one hash map of distinct values per group in the final task - only for
    bounded cardinality), ``approx`` (``percentile_approx`` sketch).
    """
    by = list(by)
    if method == "exact" and not by:
        return df.sparkSession.createDataFrame(select_quantiles(df, features, probs), "feature string, p double, q double")
    long_df = long_values(df, features, extra=by)
    if method == "exact":
        return exact_quantiles_long(long_df, by + ["feature"], probs)
    if method == "builtin":
        agg = F.percentile(F.col("value"), list(probs))
    elif method == "approx":
        agg = F.percentile_approx(F.col("value"), list(probs), SKETCH_ACCURACY)
    else:
        raise ValueError(f"unknown quantile method {method!r}")
    res = long_df.groupBy(*[col(k) for k in by], "feature").agg(agg.alias("__qs"))
    return res.select(*[col(k) for k in by], "feature",
                      F.posexplode("__qs").alias("__i", "q")).select(
        *[col(k) for k in by], "feature",
        F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("__i") + 1).alias("p"), "q")


def average_rank_desc(df: DataFrame, score: str, out: str, partition: Sequence[str] = ()) -> DataFrame:
    """Descending rank with ties averaged (pandas ``rank(ascending=False)``).

    Meant for small ranking tables (one row per feature); partition keeps groups apart.
    """
    w = Window.partitionBy(*[col(p) for p in partition]).orderBy(F.desc(col(score)))
    wt = Window.partitionBy(*[col(p) for p in partition], col(score))
    return df.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(wt) - 1) / 2.0)


def mann_whitney_auc(long_df: DataFrame, label: str, keys: Sequence[str] = ("feature",),
                     value: str = "value") -> DataFrame:
    """One-vs-rest ROC-AUC of ``value`` for every class of ``label`` within each key group.

    AUC_c = (sum of average ranks of class-c rows - P(P+1)/2) / (P*N); ties get average
    ranks, exactly as a rank-sum (Mann-Whitney U) computation. Returns
    (keys..., label, n_pos, n_neg, auc).
    """
    keys = list(keys)
    per_class = long_df.groupBy(*[col(k) for k in keys], col(value), col(label)).agg(
        F.count(F.lit(1)).alias("pos"))
    per_value = per_class.groupBy(*[col(k) for k in keys], col(value)).agg(F.sum("pos").alias("cnt"))
    ranked = prefix_sums(per_value, keys, value, ["cnt"]).select(
        *[col(k) for k in keys], col(value), (F.col("cnt_below") + (F.col("cnt") + 1) / 2.0).alias("avg_rank"))
    s = null_safe_join(per_class, ranked, [*keys, value]).groupBy(*[col(k) for k in keys], col(label)).agg(
        F.sum(F.col("pos") * F.col("avg_rank")).alias("rank_sum"), F.sum("pos").alias("n_pos"))
    return auc_of_rank_sums(s, keys).select(*[col(k) for k in keys], col(label), "n_pos", "n_neg", "auc")


def auc_of_rank_sums(s: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds n_neg and auc to (keys, rank_sum, n_pos); products are taken as doubles, counts may pass 3e9."""
    # group total = sum over its classes; the window runs on the (keys x classes) table
    s = s.withColumn("n_neg", F.sum("n_pos").over(Window.partitionBy(*[col(k) for k in keys])) - F.col("n_pos"))
    pos, neg = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return s.withColumn("auc", F.try_divide(F.col("rank_sum") - pos * (pos + 1) / 2.0, pos * neg))
