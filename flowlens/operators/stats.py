"""Aggregations and statistics (AGG-*).

Every multi-column statistic is one ``agg`` over all columns, unpivoted after;
group-level shares use the (class-sized) grouped result, never the raw rows.
"""
from __future__ import annotations

import math

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, finite, fractional
from .ranking import exact_quantiles_long, long_values, quantiles


def class_distribution(df: DataFrame, label: str, digits: int = 3) -> DataFrame:
    """AGG-01: (label, count, percent) sorted by count desc.

    The share window runs over the grouped table (one row per class).
    """
    g = df.groupBy(col(label)).agg(F.count(F.lit(1)).alias("count"))
    tot = F.sum("count").over(Window.partitionBy())
    return g.select(col(label), "count", F.round(100.0 * F.col("count") / tot, digits).alias("percent")).orderBy(F.desc("count"), col(label))


def value_counts(df: DataFrame, column: str, out: str = "count") -> DataFrame:
    """AGG-02."""
    return df.groupBy(col(column)).agg(F.count(F.lit(1)).alias(out))


def imbalance(dist: DataFrame, label: str, benign: Sequence[str] = (), top: int = 4) -> DataFrame:
    """AGG-03: majority:minority ratio, top-k share, benign share over a class distribution."""
    w = Window.orderBy(F.desc("count"), col(label))
    ranked = dist.withColumn("__r", F.row_number().over(w))
    is_benign = F.lower(F.trim(col(label))).isin([b.lower() for b in benign]) if benign else F.lit(False)
    return ranked.agg(
        F.try_divide(F.max("count").cast("double"), F.min("count")).alias("imbalance_ratio"),
        F.round(100.0 * F.sum(F.when(F.col("__r") <= top, F.col("count")).otherwise(0)) / F.sum("count"), 3).alias("top_share_pct"),
        F.round(100.0 * F.sum(F.when(is_benign, F.col("count")).otherwise(0)) / F.sum("count"), 3).alias("benign_share_pct"),
        F.count(F.lit(1)).alias("n_classes"))


def describe(df: DataFrame, features: Sequence[str], method: str = "exact") -> DataFrame:
    """AGG-04: count, mean, std (sample), min, 25/50/75 %, max per feature (long)."""
    clean = df.select(*[finite(col(f)).alias(f) if fractional(df, f) else col(f).cast("double").alias(f)
                        for f in features])
    one = clean.agg(*[e for f in features for e in (
        F.count(col(f)).alias(f"count|{f}"), F.avg(col(f)).alias(f"mean|{f}"),
        F.stddev_samp(col(f)).alias(f"std|{f}"), F.min(col(f)).alias(f"min|{f}"), F.max(col(f)).alias(f"max|{f}"))])
    long = one.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"`count|{f}`").cast("bigint").alias("count"),
                 F.col(f"`mean|{f}`").alias("mean"), F.col(f"`std|{f}`").alias("std"),
                 F.col(f"`min|{f}`").cast("double").alias("min"), F.col(f"`max|{f}`").cast("double").alias("max"))
        for f in features])).alias("s")).select("s.*")
    qs = quantiles(clean, features, [0.25, 0.5, 0.75], method=method)
    qw = qs.groupBy("feature").agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n)
                                     for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return long.join(qw, "feature", "left").select("feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def correlation_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """AGG-05: pairwise-complete Pearson r for every feature pair (long: feature_a, feature_b, r).

    Each pair is masked to rows where both sides are finite; a constant side gives
    NULL, never an error. All pairs come from one scan (masked Gram sums, operators/gram.py)."""
    from .gram import gram
    fs = list(features)
    r = gram(df, fs).correlation()
    rows = [(a, b, None if math.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(fs) for j, b in enumerate(fs) if i < j]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, r double")


def redundant_pairs(corr: DataFrame, threshold: float = 0.95, digits: int = 4) -> DataFrame:
    """AGG-06: |r| >= threshold, rounded, sorted by |r| desc."""
    return (corr.where(F.abs("r") >= threshold)
            .select("feature_a", "feature_b", F.round(F.abs("r"), digits).alias("abs_r"))
            .orderBy(F.desc("abs_r"), "feature_a", "feature_b"))


def histogram(df: DataFrame, column: str, bins: int = 40, clip_p: float = 0.99, method: str = "exact") -> DataFrame:
    """AGG-07: equal-width histogram over [min, p99] (values above p99 dropped).

    Returns (bin, lo, hi, count) for every bin; the right edge is inclusive like numpy.
    """
    clean = df.select(finite(col(column)).alias("v"))
    hi = quantiles(clean, ["v"], [clip_p], method=method).first()["q"]
    lo = clean.agg(F.min("v").alias("m")).first()["m"]
    kept = clean.where((F.col("v") >= lo) & (F.col("v") <= hi))
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    found = kept.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (every.join(found, "bin", "left").na.fill(0, ["count"])
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "count"))


def percentile_threshold(df: DataFrame, column: str, p: float = 0.99, by: Sequence[str] = ()) -> DataFrame:
    """AGG-08: exact p-th percentile of an error column (per group)."""
    long = df.select(*[col(b) for b in by], F.lit(column).alias("feature"), finite(col(column)).alias("value")) \
        .where(F.col("value").isNotNull())
    return exact_quantiles_long(long, list(by) + ["feature"], [p]).select(*[col(b) for b in by], F.col("q").alias("threshold"))


def latency_summary(timings: DataFrame, model: str = "model", ms: str = "latency_ms",
                    batch_rows: str | None = None, batch_sec: str | None = None,
                    p95_sla_ms: float = 25.0, batch_sla_sec: float = 2.0) -> DataFrame:
    """AGG-09: p50/p95/p99 per model from a timings table, throughput and SLA flags."""
    long = timings.select(col(model).alias("model"), F.lit("latency").alias("feature"), col(ms).cast("double").alias("value"))
    qs = exact_quantiles_long(long, ["model", "feature"], [0.5, 0.95, 0.99])
    wide = qs.groupBy("model").agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n)
                                     for p, n in ((0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms"))])
    out = wide.withColumn("latency_sla_ok", F.col("p95_ms") <= p95_sla_ms)
    if batch_rows and batch_sec:
        thr = timings.groupBy(col(model).alias("model")).agg(
            F.sum(col(batch_rows)).alias("__rows"), F.sum(col(batch_sec)).alias("__sec"))
        out = out.join(thr, "model", "left").select(
            "*", F.try_divide(F.col("__rows"), F.col("__sec")).alias("rows_per_sec")).drop("__rows", "__sec")
        out = out.withColumn("batch_sla_ok", F.col("rows_per_sec") >= 1000.0 / batch_sla_sec)
    return out


def actor_activity(log: DataFrame, actor: str, ts: str, added: str | None = None, removed: str | None = None,
                   bot_pattern: str = r"(?i)\[bot\]|bot$") -> DataFrame:
    """AGG-10: per actor: events, share %, added/removed sums, net, distinct active days.

    Bot actors are filtered by name pattern first.
    """
    humans = log.where(~col(actor).cast("string").rlike(bot_pattern))
    aggs = [F.count(F.lit(1)).alias("events"), F.count_distinct(F.to_date(col(ts))).alias("active_days")]
    if added:
        aggs.append(F.sum(col(added)).alias("added"))
    if removed:
        aggs.append(F.sum(col(removed)).alias("removed"))
    g = humans.groupBy(col(actor).alias("actor")).agg(*aggs)
    total = humans.count()          # one scalar; the actor table itself may be large
    g = g.withColumn("share_pct", F.round(100.0 * F.col("events") / F.lit(total), 2))
    if added and removed:
        g = g.withColumn("net", F.col("added") - F.col("removed"))
    return g


def activity_timeline(log: DataFrame, actor: str, ts: str, period: str = "day",
                      actors: Sequence[str] | None = None) -> DataFrame:
    """AGG-11: events per period x actor.

    Long output by default. Zero-filled wide output only for an explicit, bounded
    actor list (pivot columns are named, so the width never grows with the data).
    """
    p = {"day": F.to_date(col(ts)),
         "week": F.concat(F.year(F.date_trunc("week", col(ts))).cast("string"), F.lit("-W"),
                          F.lpad(F.weekofyear(col(ts)).cast("string"), 2, "0")),
         "month": F.date_format(col(ts), "yyyy-MM")}[period]
    long = log.groupBy(p.cast("string").alias("period"), col(actor).cast("string").alias("actor")).agg(
        F.count(F.lit(1)).alias("events"))
    if actors is None:
        return long
    return long.groupBy("period").pivot("actor", list(actors)).agg(F.first("events")).na.fill(0)


def dashboard_summary(records: DataFrame, label: str, alert_col: str, model_version: str) -> DataFrame:
    """AGG-12: total scanned, active alerts, model version, class distribution map.

    One grouped pass (class-sized result) and one final aggregate over it.
    """
    by_class = records.groupBy(col(label).alias("k")).agg(F.count(F.lit(1)).alias("v"),
                                                         F.sum(F.col(alert_col).cast("int")).alias("a"))
    return by_class.agg(F.sum("v").alias("total_scanned"), F.coalesce(F.sum("a"), F.lit(0)).alias("active_alerts"),
                        F.lit(model_version).alias("model_version"),
                        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("class_distribution"))


def rolled_profile(df: DataFrame, split: str, label: str) -> DataFrame:
    """AGG-13: counts per (split, label) with subtotals per split and a grand total."""
    return df.rollup(col(split), col(label)).agg(F.count(F.lit(1)).alias("rows"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["long_values"]
