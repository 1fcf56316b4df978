"""Registered queries: each is a Spark plan over the driver tables built from the
library operators, paired with an independent DuckDB SQL oracle.

Every query reads whole tables (dirt is injected by key rules, never by
filtering rows away). Floating outputs are rounded identically on both sides
(6 dp for unit-scale numbers, 2 dp for large magnitudes).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import finite
from ..operators import evaluate as EV
from ..operators import features as FS
from ..operators import fit as FIT
from ..operators import labels as TAX
from ..operators import quality as VAL
from ..operators import score as SCR
from ..operators import shape as SH
from ..operators import split as SPL
from ..operators import stats as AGG
from ..operators.ranking import quantiles
from .tables import (EVENTS_SQL, EVENTS_TAXONOMY, EVENTS_TAXONOMY_SQL, FLOWS_SQL, dirty_events, dirty_flows,
                     table)

from .registry import FEATS, KEY, LF, ORACLE, QUERIES, _q, fin, r, register  # noqa: F401


# =========================================================================== flagship


def flow_class_triage(spark: SparkSession, d: str) -> DataFrame:
    """Per class: rows, share, flagged and missed-as-normal rate after cleaning.

    scan -> FLT-01 -> FIT-01/02 median impute -> TAX-01/02 -> rule scorer
    (value above the p75 of Normal-category rows) -> EVAL-10 style roll-up.
    """
    ev = SH.replace_infinite(dirty_events(spark, d), ["value"])
    ev = FIT.apply_imputer(ev, FIT.fit_imputer(ev, ["value"], "median"))
    ev = TAX.map_labels(ev, "event_type", "events", TAX.taxonomy(spark, EVENTS_TAXONOMY))
    thr = _q(spark, ev.where(F.col("category") == "Normal"), 0.75, "value")
    ev = ev.withColumn("predicted_attack", F.col("value") > F.lit(thr))
    g = ev.groupBy("event_type", "category", "severity").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("predicted_attack").cast("int")).cast("bigint").alias("flagged"),
        F.sum((~F.col("predicted_attack")).cast("int")).alias("__missed"))
    share = F.round(100.0 * F.col("rows") / F.sum("rows").over(Window.partitionBy()), 3)
    return g.select("event_type", "category", "severity", "rows", share.alias("percent"), "flagged",
                    F.when(SH.attack_category_expr("category"),
                           F.round(100.0 * F.col("__missed") / F.col("rows"), 2)).alias("miss_rate_pct"))


register("flow_class_triage", f"""
WITH {EVENTS_SQL}, {EVENTS_TAXONOMY_SQL},
e1 AS (SELECT *, {fin('value')} AS v FROM ev),
med AS (SELECT quantile_cont(v, 0.5) AS m FROM e1),
e2 AS (SELECT e1.event_type, coalesce(e1.v, med.m) AS vi FROM e1, med),
e3 AS (SELECT e2.*, coalesce(tax.category, 'Other') AS category, coalesce(tax.severity, 'medium') AS severity
       FROM e2 LEFT JOIN tax ON trim(e2.event_type) = tax.raw_label AND tax.dataset = 'events'),
thr AS (SELECT quantile_cont(vi, 0.75) AS t FROM e3 WHERE category = 'Normal'),
e4 AS (SELECT e3.*, e3.vi > thr.t AS pa FROM e3, thr)
SELECT event_type, category, severity, count(*) AS rows,
  round(100.0 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 3) AS percent,
  CAST(sum(CASE WHEN pa THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
  CASE WHEN category IN ('DoS', 'Probe', 'R2L', 'U2R')
       THEN round(100.0 * CAST(sum(CASE WHEN pa THEN 0 ELSE 1 END) AS DOUBLE) / count(*), 2) END AS miss_rate_pct
FROM e4 GROUP BY event_type, category, severity
""")(flow_class_triage)


# =========================================================================== VAL


def _validate_sql() -> str:
    frac = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    ints = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    aggs = ["sum(cnt) AS n", "sum(cnt - 1) AS dup"]
    for c in frac:
        aggs += [f"sum(CASE WHEN isinf({c}) THEN cnt ELSE 0 END) AS inf_{c}",
                 f"sum(CASE WHEN {c} IS NULL OR isnan({c}) THEN cnt ELSE 0 END) AS nan_{c}",
                 f"coalesce(min({fin(c)}) = max({fin(c)}), true) AS const_{c}"]
    for c in ints:
        aggs += [f"sum(CASE WHEN {c} IS NULL THEN cnt ELSE 0 END) AS nan_{c}",
                 f"coalesce(min({c}) = max({c}), true) AS const_{c}"]
    for c in LF.non_negative:
        aggs += [f"sum(CASE WHEN {c} < 0 THEN cnt ELSE 0 END) AS neg_{c}"]
    parts = []
    for c in frac:
        parts.append(f"SELECT 'infinite_values' AS \"check\", '{c}' AS \"column\", CAST(inf_{c} AS DOUBLE) AS count, "
                     f"round(CAST(inf_{c} AS DOUBLE) / n, 6) AS ratio, 'warning' AS severity FROM a WHERE inf_{c} > 0")
    for c in frac + ints:
        parts.append(f"SELECT 'missing_values', '{c}', CAST(nan_{c} AS DOUBLE), round(CAST(nan_{c} AS DOUBLE) / n, 6), "
                     f"CASE WHEN CAST(nan_{c} AS DOUBLE) / n > 0.05 THEN 'error' ELSE 'info' END FROM a WHERE nan_{c} > 0")
        parts.append(f"SELECT 'zero_variance', '{c}', NULL, NULL, 'warning' FROM a WHERE const_{c}")
    for c in LF.non_negative:
        parts.append(f"SELECT 'negative_values', '{c}', CAST(neg_{c} AS DOUBLE), round(CAST(neg_{c} AS DOUBLE) / n, 6), "
                     f"'error' FROM a WHERE neg_{c} > 0")
    parts.append("SELECT 'duplicate_rows', NULL, CAST(dup AS DOUBLE), round(CAST(dup AS DOUBLE) / n, 6), 'warning' "
                 "FROM a WHERE dup > 0")
    parts.append("SELECT 'invalid_label', l_returnflag, CAST(sum(cnt) AS DOUBLE), NULL, 'warning' FROM g "
                 "WHERE l_returnflag IS NOT NULL AND l_returnflag NOT IN ('A', 'N') GROUP BY l_returnflag")
    for c in sorted(set(LF.identity)):
        parts.append(f"SELECT 'leakage_column', '{c}', NULL, NULL, 'warning'")
    return (f"WITH {FLOWS_SQL},\n g AS (SELECT *, count(*) AS cnt FROM flows_all GROUP BY ALL),\n"
            f" a AS (SELECT {', '.join(aggs)} FROM g)\n" + "\nUNION ALL ".join(parts))


@register("validate_flows", _validate_sql())
def validate_flows(spark: SparkSession, d: str) -> DataFrame:
    """VAL-01..07: long findings table for the dirty flow table."""
    v = VAL.validate(dirty_flows(spark, d), LF)
    # count is NULL for schema rows: compared as double so both engines type it alike
    return v.select("check", "column", F.col("count").cast("double").alias("count"), r("ratio").alias("ratio"), "severity")


@register("validate_summary", f"""
WITH {FLOWS_SQL},
g AS (SELECT *, count(*) AS cnt FROM flows_all GROUP BY ALL),
a AS (SELECT sum(cnt) AS n, sum(cnt - 1) AS dup,
        sum(CASE WHEN isinf(l_extendedprice) THEN cnt ELSE 0 END) AS infs,
        sum(CASE WHEN l_quantity IS NULL OR isnan(l_quantity) THEN cnt ELSE 0 END)
          + sum(CASE WHEN l_discount IS NULL OR isnan(l_discount) THEN cnt ELSE 0 END) AS nans,
        sum(CASE WHEN l_extendedprice < 0 THEN cnt ELSE 0 END) AS negs FROM g)
SELECT 'lineitem' AS dataset_name, CAST(n AS BIGINT) AS total_records, 11 AS total_features,
  (negs = 0) AS is_valid, CAST(CASE WHEN negs > 0 THEN 1 ELSE 0 END AS BIGINT) AS error_count,
  CAST(4 + (CASE WHEN infs > 0 THEN 1 ELSE 0 END) + (CASE WHEN dup > 0 THEN 1 ELSE 0 END)
       + (SELECT count(DISTINCT l_returnflag) FROM flows_all WHERE l_returnflag NOT IN ('A', 'N')) AS BIGINT) AS warning_count, CAST(dup AS BIGINT) AS duplicate_record_count,
  CAST(infs AS BIGINT) AS total_infinite_values, CAST(nans AS BIGINT) AS total_nan_values,
  round(1.0 - CAST(dup AS DOUBLE) / n, 6) AS valid_records_ratio, CAST(11 - 4 AS BIGINT) AS clean_features_count
FROM a
""")
def validate_summary(spark: SparkSession, d: str) -> DataFrame:
    """VAL-08: summary row (validity, counts, valid ratio, clean feature count)."""
    df = dirty_flows(spark, d)
    s = VAL.summarize(VAL.validate(df, LF), df, LF)
    return s.select("dataset_name", "total_records", "total_features", "is_valid",
                    F.col("error_count").cast("bigint").alias("error_count"),
                    F.col("warning_count").cast("bigint").alias("warning_count"),
                    F.col("duplicate_record_count").cast("bigint").alias("duplicate_record_count"),
                    F.col("total_infinite_values").cast("bigint").alias("total_infinite_values"),
                    F.col("total_nan_values").cast("bigint").alias("total_nan_values"),
                    r("valid_records_ratio").alias("valid_records_ratio"),
                    F.col("clean_features_count").cast("bigint").alias("clean_features_count"))


@register("quick_profile", f"""
WITH {FLOWS_SQL},
g AS (SELECT *, count(*) AS cnt FROM flows_all GROUP BY ALL)
SELECT CAST(sum(cnt) AS BIGINT) AS rows, 11 AS columns, CAST(sum(cnt - 1) AS BIGINT) AS duplicate_rows,
  CAST(sum(cnt * ((CASE WHEN l_quantity IS NULL OR isnan(l_quantity) THEN 1 ELSE 0 END)
                + (CASE WHEN l_discount IS NULL OR isnan(l_discount) THEN 1 ELSE 0 END))) AS BIGINT) AS missing_cells,
  CAST(sum(cnt * (CASE WHEN isinf(l_extendedprice) THEN 1 ELSE 0 END)) AS BIGINT) AS infinite_cells,
  8 AS numeric_columns, 3 AS other_columns
FROM g
""")
def quick_profile(spark: SparkSession, d: str) -> DataFrame:
    """VAL-11: shape, duplicates, missing and infinite cells, dtype counts."""
    return VAL.quick_profile(dirty_flows(spark, d))


@register("missing_percent", f"""
WITH {FLOWS_SQL}
SELECT feature, missing_pct FROM (
  SELECT 'l_quantity' AS feature, round(100.0 * avg(CASE WHEN l_quantity IS NULL OR isnan(l_quantity) THEN 1.0 ELSE 0.0 END), 2) AS missing_pct FROM flows_all
  UNION ALL SELECT 'l_extendedprice', round(100.0 * avg(CASE WHEN l_extendedprice IS NULL OR isnan(l_extendedprice) THEN 1.0 ELSE 0.0 END), 2) FROM flows_all
  UNION ALL SELECT 'l_discount', round(100.0 * avg(CASE WHEN l_discount IS NULL OR isnan(l_discount) THEN 1.0 ELSE 0.0 END), 2) FROM flows_all
  UNION ALL SELECT 'l_tax', round(100.0 * avg(CASE WHEN l_tax IS NULL OR isnan(l_tax) THEN 1.0 ELSE 0.0 END), 2) FROM flows_all)
""")
def missing_percent(spark: SparkSession, d: str) -> DataFrame:
    """VAL-13."""
    return VAL.missing_percent(dirty_flows(spark, d), FEATS).select("feature", F.col("missing_pct").cast("double"))


def _per_feature_sql(expr_tpl: str, src: str = "flows_all", feats=None) -> str:
    feats = feats or FEATS
    return "\nUNION ALL ".join(f"SELECT '{f}' AS feature, {expr_tpl.format(x=fin(f))} FROM {src}" for f in feats)


@register("near_zero_variance", f"""
WITH {FLOWS_SQL}
{_per_feature_sql("round(var_samp({x}), 2) AS variance, coalesce(var_samp({x}) < 1e-4, false) AS near_zero")}
""")
def near_zero_variance(spark: SparkSession, d: str) -> DataFrame:
    """VAL-14 (after FLT-01)."""
    df = SH.replace_infinite(dirty_flows(spark, d), FEATS)
    return VAL.near_zero_variance(df, FEATS).select("feature", r("variance", 2).alias("variance"), "near_zero")


@register("outlier_percent", f"""
WITH {FLOWS_SQL},
c AS (SELECT {', '.join(f'{fin(f)} AS {f}' for f in FEATS)} FROM flows_all),
q AS ({_per_feature_sql("quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3", "c")}),
l AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f} AS value FROM c" for f in FEATS)})
SELECT l.feature, CASE WHEN q3 - q1 = 0 THEN 0.0 ELSE
  round(100.0 * avg(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END), 2) END AS outlier_pct
FROM l JOIN q ON l.feature = q.feature GROUP BY l.feature, q1, q3
""")
def outlier_percent(spark: SparkSession, d: str) -> DataFrame:
    """VAL-15: IQR-rule outlier percent (after FLT-01)."""
    df = SH.replace_infinite(dirty_flows(spark, d), FEATS)
    return VAL.outlier_percent(df, FEATS)


# =========================================================================== AGG


@register("class_distribution", """
SELECT l_returnflag, count(*) AS count, round(100.0 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 3) AS percent
FROM lineitem GROUP BY l_returnflag
""")
def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    """AGG-01 / AGG-02 / WIN-03."""
    return AGG.class_distribution(table(spark, d, "lineitem"), "l_returnflag")


@register("class_imbalance", """
WITH dist AS (SELECT event_type, count(*) AS c FROM events GROUP BY event_type),
rk AS (SELECT *, row_number() OVER (ORDER BY c DESC, event_type) AS rn FROM dist)
SELECT round(CAST(max(c) AS DOUBLE) / min(c), 6) AS imbalance_ratio,
  round(100.0 * CAST(sum(CASE WHEN rn <= 4 THEN c ELSE 0 END) AS DOUBLE) / sum(c), 3) AS top_share_pct,
  round(100.0 * CAST(sum(CASE WHEN lower(trim(event_type)) IN ('click', 'view', 'purchase', 'signup') THEN c ELSE 0 END) AS DOUBLE) / sum(c), 3) AS benign_share_pct,
  count(*) AS n_classes
FROM rk
""")
def class_imbalance(spark: SparkSession, d: str) -> DataFrame:
    """AGG-03."""
    dist = AGG.class_distribution(table(spark, d, "events"), "event_type")
    out = AGG.imbalance(dist, "event_type", C.EVENTS_FLOWS.benign)
    return out.select(r("imbalance_ratio").alias("imbalance_ratio"), "top_share_pct", "benign_share_pct", "n_classes")


@register("describe_flows", f"""
WITH {FLOWS_SQL},
c AS (SELECT {', '.join(f'{fin(f)} AS {f}' for f in FEATS)} FROM flows_all)
{' UNION ALL '.join(f"SELECT '{f}' AS feature, count({f}) AS count, round(avg({f}), 4) AS mean, round(stddev_samp({f}), 4) AS std, "
                    f"round(min({f}), 4) AS min, round(quantile_cont({f}, 0.25), 4) AS p25, round(quantile_cont({f}, 0.5), 4) AS p50, "
                    f"round(quantile_cont({f}, 0.75), 4) AS p75, round(max({f}), 4) AS max FROM c" for f in FEATS)}
""")
def describe_flows(spark: SparkSession, d: str) -> DataFrame:
    """AGG-04 (after FLT-01), exact quartiles."""
    s = AGG.describe(dirty_flows(spark, d), FEATS)
    return s.select("feature", "count", *[r(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


_PAIRS = [(a, b) for i, a in enumerate(FEATS) for b in FEATS[i + 1:]]
_COPY_PAIRS = [(a, b) for i, a in enumerate([*FEATS, "price_copy", "quantity_copy"]) for b in [*FEATS, "price_copy", "quantity_copy"][i + 1:]]
_CORR_SQL = f"""
WITH {FLOWS_SQL},
c AS (SELECT {', '.join(f'{fin(f)} AS {f}' for f in FEATS)} FROM flows_all),
p AS ({' UNION ALL '.join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, "
    f"covar_pop(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} END, CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {b} END) "
    f"/ nullif(stddev_pop(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} END) * stddev_pop(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {b} END), 0) AS r FROM c"
    for a, b in _PAIRS)})"""


@register("correlation_pairs", _CORR_SQL + "\nSELECT feature_a, feature_b, round(r, 6) AS r FROM p")
def correlation_pairs(spark: SparkSession, d: str) -> DataFrame:
    """AGG-05: pairwise-complete Pearson r."""
    c = AGG.correlation_pairs(dirty_flows(spark, d), FEATS)
    return c.select("feature_a", "feature_b", r("r").alias("r"))


@register("redundant_pairs", f"""
WITH {FLOWS_SQL},
c AS (SELECT {', '.join(f'{fin(f)} AS {f}' for f in FEATS)}, 2 * {fin('l_extendedprice')} + 1 AS price_copy, -{fin('l_quantity')} AS quantity_copy FROM flows_all),
p AS ({' UNION ALL '.join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr(CASE WHEN {b} IS NOT NULL THEN {a} END, CASE WHEN {a} IS NOT NULL THEN {b} END) AS r FROM c"
    for a, b in _COPY_PAIRS)})
SELECT feature_a, feature_b, round(abs(r), 4) AS abs_r FROM p WHERE abs(r) >= 0.95""")
def redundant_pairs(spark: SparkSession, d: str) -> DataFrame:
    """AGG-06: two features are scaled copies of others, so the report has pairs to find."""
    flows = dirty_flows(spark, d).withColumn("price_copy", 2 * F.col("l_extendedprice") + 1).withColumn("quantity_copy", -F.col("l_quantity"))
    return AGG.redundant_pairs(AGG.correlation_pairs(flows, [*FEATS, "price_copy", "quantity_copy"]), 0.95)


@register("price_histogram", f"""
WITH {FLOWS_SQL},
c AS (SELECT {fin('l_extendedprice')} AS v FROM flows_all),
b AS (SELECT min(v) AS lo, quantile_cont(v, 0.99) AS hi FROM c),
w AS (SELECT lo, hi, (hi - lo) / 40 AS width FROM b)
SELECT CAST(i AS INTEGER) AS bin, count(v) AS count FROM range(40) r(i)
LEFT JOIN (SELECT v, least(floor((v - lo) / width), 39) AS b FROM c, w WHERE v >= lo AND v <= hi) ON b = i GROUP BY 1
""")
def price_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AGG-07 + FLT-09: 40 equal-width bins after the p99 clip."""
    return AGG.histogram(dirty_flows(spark, d), "l_extendedprice", 40, 0.99).select("bin", "count")


@register("latency_sla", """
SELECT event_type AS model, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms,
  round(quantile_cont(value, 0.99), 6) AS p99_ms, quantile_cont(value, 0.95) <= 25.0 AS latency_sla_ok
FROM events GROUP BY event_type
""")
def latency_sla(spark: SparkSession, d: str) -> DataFrame:
    """AGG-09: events stand in for a timings table (model = event_type, ms = value)."""
    t = AGG.latency_summary(table(spark, d, "events"), "event_type", "value")
    return t.select("model", r("p50_ms").alias("p50_ms"), r("p95_ms").alias("p95_ms"), r("p99_ms").alias("p99_ms"),
                    "latency_sla_ok")


@register("actor_activity", """
WITH a AS (SELECT CAST(user_id AS VARCHAR) AS actor, count(*) AS events, count(DISTINCT CAST(ts AS DATE)) AS active_days,
                  sum(value) AS added, sum(CASE WHEN event_type = 'error' THEN value ELSE 0.0 END) AS removed
           FROM events GROUP BY user_id)
SELECT actor, events, active_days, round(added, 2) AS added, round(removed, 2) AS removed,
  round(100.0 * CAST(events AS DOUBLE) / sum(events) OVER (), 2) AS share_pct, round(added - removed, 2) AS net
FROM a
""")
def actor_activity(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10: the events log as an activity log (actor = user)."""
    ev = table(spark, d, "events").withColumn("actor", F.col("user_id").cast("string")) \
        .withColumn("removed", F.when(F.col("event_type") == "error", F.col("value")).otherwise(0.0))
    a = AGG.actor_activity(ev, "actor", "ts", added="value", removed="removed")
    return a.select("actor", "events", "active_days", r("added", 2).alias("added"), r("removed", 2).alias("removed"),
                    "share_pct", r("net", 2).alias("net"))


@register("activity_timeline", """
SELECT CAST(year(date_trunc('week', ts) + INTERVAL 3 DAY) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0') AS period,
  event_type AS actor, count(*) AS events
FROM events GROUP BY 1, 2
""")
def activity_timeline(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11 (ISO week x event type, long form)."""
    return AGG.activity_timeline(table(spark, d, "events"), "event_type", "ts", "week")


@register("dashboard_summary", """
WITH c AS (SELECT event_type AS k, count(*) AS v FROM events GROUP BY 1)
SELECT (SELECT count(*) FROM events) AS total_scanned,
  (SELECT count(*) FROM events WHERE event_type = 'error') AS active_alerts,
  'rules-v1' AS model_version,
  '{' || string_agg('"' || k || '":' || CAST(v AS VARCHAR), ',' ORDER BY k) || '}' AS class_distribution
FROM c
""")
def dashboard_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12: total scanned, active alerts, model version, class distribution (JSON map)."""
    ev = table(spark, d, "events").withColumn("is_alert", F.col("event_type") == "error")
    s = AGG.dashboard_summary(ev, "event_type", "is_alert", "rules-v1")
    return s.select("total_scanned", F.col("active_alerts").cast("bigint").alias("active_alerts"), "model_version",
                    F.to_json("class_distribution").alias("class_distribution"))


def _split_sql(src: str, label: str, keys: list[str], train=0.7, val=0.15) -> str:
    kexpr = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5({kexpr} || ':42'), {', '.join(keys)}) - 1 AS pos,
         count(*) OVER (PARTITION BY {label}) AS n
  FROM {src} WHERE {label} IS NOT NULL),
split_t AS (SELECT *, CASE WHEN pos < floor(n * {train}) THEN 'train'
                    WHEN pos < floor(n * {train}) + floor(n * {val}) THEN 'val' ELSE 'test' END AS split FROM ranked)"""


@register("rolled_profile", f"""
WITH {_split_sql('lineitem', 'l_returnflag', KEY)}
SELECT split, l_returnflag, count(*) AS rows FROM split_t GROUP BY ROLLUP (split, l_returnflag)
""")
def rolled_profile(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13: per (split, label) with split subtotals and the grand total."""
    s = SPL.stratified_split(table(spark, d, "lineitem"), "l_returnflag", KEY)
    return AGG.rolled_profile(s, "split", "l_returnflag")


# =========================================================================== SPL


@register("stratified_split", f"""
WITH {_split_sql('lineitem', 'l_returnflag', KEY)}
SELECT l_returnflag, split, count(*) AS rows, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM split_t GROUP BY 1, 2
""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """SPL-01 / WIN-02: 70/15/15 per class with floors, md5 order; key_sum pins row membership."""
    s = SPL.stratified_split(table(spark, d, "lineitem"), "l_returnflag", KEY)
    return s.groupBy("l_returnflag", "split").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").alias("key_sum"))


@register("two_way_split", f"""
WITH {_split_sql('events', 'event_type', ['event_id'], 0.8, 0.0)}
SELECT event_type, CASE WHEN split = 'val' THEN 'test' ELSE split END AS split, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS key_sum
FROM split_t GROUP BY 1, 2
""")
def two_way_split(spark: SparkSession, d: str) -> DataFrame:
    """SPL-02: stratified 80/20."""
    s = SPL.stratified_two_way(table(spark, d, "events"), "event_type", ["event_id"], 0.2)
    return s.groupBy("event_type", "split").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("key_sum"))


@register("prefix_split", """
WITH ranked AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id) - 1 AS pos,
                       count(*) OVER () AS n FROM events)
SELECT CASE WHEN pos < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS key_sum
FROM ranked GROUP BY 1
""")
def prefix_split(spark: SparkSession, d: str) -> DataFrame:
    """SPL-03: unstratified shuffled-prefix split (global positions without a global sort)."""
    s = SPL.shuffled_prefix_split(table(spark, d, "events"), ["event_id"], 0.8)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("key_sum"))


@register("fixed_sample", """
SELECT event_id, event_type FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id LIMIT 200
""")
def fixed_sample(spark: SparkSession, d: str) -> DataFrame:
    """SPL-04: a 200-row deterministic sample (the limit is the operator)."""
    return SPL.fixed_sample(table(spark, d, "events"), ["event_id"], 200).select("event_id", "event_type")


@register("class_weights", """
WITH n AS (SELECT l_returnflag, count(*) AS nc FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(CAST(sum(nc) OVER () AS DOUBLE) / (count(*) OVER () * nc), 6) AS weight FROM n
""")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    """SPL-06: N / (K * N_c)."""
    w = SPL.class_weights(table(spark, d, "lineitem"), "l_returnflag")
    return w.select("l_returnflag", r("weight").alias("weight")).distinct()


@register("temporal_split", """
WITH c AS (SELECT quantile_cont(CAST(epoch_us(ts) AS DOUBLE), 0.8) AS cut FROM events)
SELECT CASE WHEN CAST(epoch_us(ts) AS DOUBLE) <= cut THEN 'train' ELSE 'test' END AS split, count(*) AS rows,
       CAST(sum(event_id) AS BIGINT) AS key_sum
FROM events, c GROUP BY 1
""")
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    """SPL-07: past trains, future tests (cut at the 80th time percentile)."""
    s = SPL.temporal_split(table(spark, d, "events"), "ts", 0.8)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("key_sum"))


@register("stratified_cap", f"""
WITH {_split_sql('lineitem', 'l_returnflag', KEY)}
SELECT l_returnflag, count(*) AS rows FROM split_t
WHERE pos < floor(n * (CAST(10000 AS DOUBLE) / (SELECT count(*) FROM lineitem))) GROUP BY 1
""")
def stratified_cap(spark: SparkSession, d: str) -> DataFrame:
    """SPL-05: cap the training pool at 10 000 rows, stratified."""
    s = SPL.stratified_cap(table(spark, d, "lineitem"), "l_returnflag", KEY, 10000)
    return s.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"))
