"""Registered queries: fit / transform (FIT-*), feature statistics (FS-*), taxonomy (TAX-*)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import finite
from ..operators import features as FS
from ..operators import fit as FIT
from ..operators import labels as TAX
from ..operators import shape as SH
from ..operators import split as SPL
from ..session import cut_lineage
from . import prepare as PREP
from .catalog import _split_sql
from .registry import FEATS, KEY, LF, fin, r, register
from .tables import (EVENTS_SQL, EVENTS_TAXONOMY, EVENTS_TAXONOMY_SQL, FLOWS_SQL, dirty_events, dirty_flows,
                     table)


def _split_lineitem(spark, d):
    # reused by a fit (action) and the transform: materialized once, without the columns that neither reads
    return cut_lineage(SPL.stratified_split(table(spark, d, "lineitem"), "l_returnflag", KEY).select("split", *FEATS))


def _avg_by_split(df: DataFrame, feats, digits=6) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), *[r(F.avg(f), digits).alias(f) for f in feats])


def _avg_sql(expr_of, feats, src="scaled", digits=6, by="split"):
    cols = ", ".join(f"round(avg({expr_of(f)}), {digits}) + 0.0 AS {f}" for f in feats)
    return f"SELECT {by}, count(*) AS rows, {cols} FROM {src} GROUP BY {by}"


_SPLIT = _split_sql("lineitem", "l_returnflag", KEY)

# --------------------------------------------------------------------------- FIT


@register("minmax_scaled", f"""
WITH {_SPLIT},
p AS (SELECT {', '.join(f"min({f}) AS mn_{f}, CASE WHEN max({f}) = min({f}) THEN 1.0 ELSE max({f}) - min({f}) END AS df_{f}" for f in FEATS)}
      FROM split_t WHERE split = 'train'),
scaled AS (SELECT split, {', '.join(f"least(greatest(({f} - mn_{f}) / df_{f}, 0.0), 1.0) AS {f}" for f in FEATS)} FROM split_t, p)
{_avg_sql(lambda f: f, FEATS)}
""")
def minmax_scaled(spark: SparkSession, d: str) -> DataFrame:
    """FIT-04: min-max fitted on train, clipped to [0, 1], applied to every split."""
    s = _split_lineitem(spark, d)
    p = FIT.fit_scaler(s.where(F.col("split") == "train"), FEATS, "minmax")
    return _avg_by_split(FIT.apply_scaler(s, p, keep=["split"]), FEATS)


@register("standard_scaled", f"""
WITH {_SPLIT},
p AS (SELECT {', '.join(f"avg({f}) AS m_{f}, CASE WHEN stddev_samp({f}) = 0 THEN 1.0 ELSE stddev_samp({f}) END AS s_{f}" for f in FEATS)}
      FROM split_t WHERE split = 'train'),
scaled AS (SELECT split, {', '.join(f"({f} - m_{f}) / s_{f} AS {f}" for f in FEATS)} FROM split_t, p)
{_avg_sql(lambda f: f, FEATS)}
""")
def standard_scaled(spark: SparkSession, d: str) -> DataFrame:
    """FIT-05: z-score with sample std fitted on train."""
    s = _split_lineitem(spark, d)
    p = FIT.fit_scaler(s.where(F.col("split") == "train"), FEATS, "standard")
    return _avg_by_split(FIT.apply_scaler(s, p, keep=["split"]), FEATS)


@register("robust_scaled", f"""
WITH {_SPLIT},
p AS (SELECT {', '.join(f"quantile_cont({f}, 0.5) AS md_{f}, CASE WHEN quantile_cont({f}, 0.75) = quantile_cont({f}, 0.25) THEN 1.0 ELSE quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) END AS iq_{f}" for f in FEATS)}
      FROM split_t WHERE split = 'train'),
scaled AS (SELECT split, {', '.join(f"({f} - md_{f}) / iq_{f} AS {f}" for f in FEATS)} FROM split_t, p)
{_avg_sql(lambda f: f, FEATS)}
""")
def robust_scaled(spark: SparkSession, d: str) -> DataFrame:
    """FIT-06: median / IQR (exact, distributed quantiles) fitted on train."""
    s = _split_lineitem(spark, d)
    p = FIT.fit_scaler(s.where(F.col("split") == "train"), FEATS, "robust")
    return _avg_by_split(FIT.apply_scaler(s, p, keep=["split"]), FEATS)


@register("zscore_population", f"""
WITH {FLOWS_SQL},
f0 AS (SELECT l_returnflag, {', '.join(f"coalesce({fin(f)}, 0.0) AS {f}" for f in FEATS)} FROM flows_all),
p AS (SELECT {', '.join(f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END AS s_{f}" for f in FEATS)} FROM f0),
scaled AS (SELECT l_returnflag, {', '.join(f"({f} - m_{f}) / s_{f} AS {f}" for f in FEATS)} FROM f0, p)
{_avg_sql(lambda f: f, FEATS, by="l_returnflag")}
""")
def zscore_population(spark: SparkSession, d: str) -> DataFrame:
    """FIT-07: inf/NaN/NULL -> 0 first, then population z-score."""
    df = dirty_flows(spark, d).select("l_returnflag", *FEATS)
    out, _ = FIT.zscore_pop_fill(df, FEATS, keep=["l_returnflag"])
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), *[r(F.avg(f)).alias(f) for f in FEATS])


@register("scaling_check", f"""
WITH {_SPLIT},
p AS (SELECT {', '.join(f"avg({f}) AS m_{f}, CASE WHEN stddev_samp({f}) = 0 THEN 1.0 ELSE stddev_samp({f}) END AS s_{f}" for f in FEATS)}
      FROM split_t WHERE split = 'train'),
scaled AS (SELECT {', '.join(f"({f} - m_{f}) / s_{f} AS {f}" for f in FEATS)} FROM split_t, p WHERE split = 'train'),
st AS (SELECT {', '.join(f"avg({f}) AS a_{f}, stddev_pop({f}) AS d_{f}" for f in FEATS)} FROM scaled)
SELECT round(greatest({', '.join(f"abs(a_{f})" for f in FEATS)}), 6) AS max_abs_mean,
       round(greatest({', '.join(f"abs(d_{f} - 1)" for f in FEATS)}), 6) AS max_abs_std_dev FROM st
""")
def scaling_check(spark: SparkSession, d: str) -> DataFrame:
    """FIT-13: after standard scaling the train split has mean ~0 and std ~1."""
    s = _split_lineitem(spark, d)
    tr = s.where(F.col("split") == "train")
    scaled = FIT.apply_scaler(tr, FIT.fit_scaler(tr, FEATS, "standard"), keep=[])
    c = FIT.check_scaling(scaled, FEATS)
    return c.select(r("max_abs_mean").alias("max_abs_mean"), r("max_abs_std_dev").alias("max_abs_std_dev"))


@register("median_impute", f"""
WITH {FLOWS_SQL},
{_split_sql('flows_all', 'l_returnflag', KEY)},
m AS (SELECT {', '.join(f"quantile_cont({fin(f)}, 0.5) AS md_{f}" for f in FEATS)} FROM split_t WHERE split = 'train'),
imp AS (SELECT split, {', '.join(f"coalesce({fin(f)}, md_{f}) AS {f}" for f in FEATS)} FROM split_t, m)
SELECT split, count(*) AS rows, {', '.join(f"round(avg({f}), 6) AS {f}" for f in FEATS)} FROM imp GROUP BY split
""")
def median_impute(spark: SparkSession, d: str) -> DataFrame:
    """FIT-01/02: medians of finite train values fill NULL/NaN/inf in every split."""
    s = cut_lineage(SPL.stratified_split(dirty_flows(spark, d), "l_returnflag", KEY))
    imp = FIT.fit_imputer(s.where(F.col("split") == "train"), FEATS, "median")
    out = FIT.apply_imputer(s, imp)
    # per-split means: well-conditioned across engines (large sums sit at the float-noise floor)
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), *[r(F.avg(f)).alias(f) for f in FEATS])


@register("label_index", f"""
WITH {_split_sql('events', 'event_type', ['event_id'])},
idx AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS idx
        FROM (SELECT DISTINCT event_type FROM split_t WHERE split = 'train'))
SELECT e.event_type, coalesce(idx.idx, -1) AS y, coalesce(idx.event_type, 'Class_' || CAST(coalesce(idx.idx, -1) AS VARCHAR)) AS decoded,
       count(*) AS rows
FROM events e LEFT JOIN idx ON e.event_type = idx.event_type GROUP BY 1, 2, 3
""")
def label_index(spark: SparkSession, d: str) -> DataFrame:
    """FIT-09 / FIT-11: sorted label -> index fitted on train, unseen -> -1, decoded back."""
    ev = table(spark, d, "events")
    s = SPL.stratified_split(ev, "event_type", ["event_id"])
    idx = FIT.fit_label_index(s.where(F.col("split") == "train"), "event_type")
    out = FIT.apply_label_index(ev, idx, "event_type", "y")
    out = FIT.decode_index(out, idx, "event_type", "y", "decoded")
    return out.groupBy("event_type", "y", "decoded").agg(F.count(F.lit(1)).alias("rows"))


@register("category_encoding", """
WITH ep AS (SELECT 'o_orderpriority' AS col, o_orderpriority AS value FROM orders
            UNION SELECT 'o_orderstatus', o_orderstatus FROM orders),
enc AS (SELECT col, value, CAST(row_number() OVER (PARTITION BY col ORDER BY value) - 1 AS BIGINT) AS code FROM ep)
SELECT p.code AS o_orderpriority, s.code AS o_orderstatus, count(*) AS rows
FROM orders o JOIN enc p ON p.col = 'o_orderpriority' AND p.value = o.o_orderpriority
              JOIN enc s ON s.col = 'o_orderstatus' AND s.value = o.o_orderstatus
GROUP BY 1, 2
""")
def category_encoding(spark: SparkSession, d: str) -> DataFrame:
    """FIT-10: one (column, value, code) encoder table for all non-numeric features."""
    o = table(spark, d, "orders")
    cols = ["o_orderpriority", "o_orderstatus"]
    enc = FIT.fit_category_encoder(o, cols)
    out = FIT.apply_category_encoder(o, enc, cols)
    return out.groupBy(*cols).agg(F.count(F.lit(1)).alias("rows"))


def _prepare_sql(flows: str = FLOWS_SQL) -> str:
    feats = FEATS
    return f"""
WITH {flows},
{_split_sql('flows_all', 'l_returnflag', KEY)},
med AS (SELECT {', '.join(f"quantile_cont({fin(f)}, 0.5) AS md_{f}" for f in feats)} FROM split_t WHERE split = 'train'),
dd AS (SELECT DISTINCT split, l_returnflag, {', '.join(feats)} FROM split_t),
cl AS (SELECT split, l_returnflag, {', '.join(f"coalesce({fin(f)}, md_{f}) AS {f}" for f in feats)} FROM dd, med),
p AS (SELECT {', '.join(f"min({f}) AS mn_{f}, CASE WHEN max({f}) = min({f}) THEN 1.0 ELSE max({f}) - min({f}) END AS df_{f}" for f in feats)}
      FROM cl WHERE split = 'train'),
idx AS (SELECT l_returnflag, CAST(row_number() OVER (ORDER BY l_returnflag) - 1 AS BIGINT) AS idx
        FROM (SELECT DISTINCT l_returnflag FROM cl WHERE split = 'train')),
scaled AS (SELECT cl.split, coalesce(idx.idx, -1) AS y,
                  CAST(lower(trim(cl.l_returnflag)) NOT IN ('n') AS INTEGER) AS y_binary,
                  {', '.join(f"least(greatest((cl.{f} - mn_{f}) / df_{f}, 0.0), 1.0) AS {f}" for f in feats)}
           FROM cl CROSS JOIN p LEFT JOIN idx ON cl.l_returnflag = idx.l_returnflag)
SELECT split, y, y_binary, count(*) AS rows, {', '.join(f"round(avg({f}), 6) AS {f}" for f in feats)}
FROM scaled GROUP BY split, y, y_binary
"""


@register("prepare_flows", _prepare_sql())
def prepare_flows(spark: SparkSession, d: str) -> DataFrame:
    """FIT-14 / FIT-03 / FIT-12: validate -> split raw rows -> fit cleaner + min-max on
    train -> transform all splits (dedup within split) -> y, y_binary."""
    p = PREP.fit_transform(dirty_flows(spark, d), LF, KEY, "minmax", "median", strict=False)  # dirty on purpose
    return p.data.groupBy("split", "y", "y_binary").agg(F.count(F.lit(1)).alias("rows"),
                                                       *[r(F.avg(f)).alias(f) for f in p.features])


@register("strict_preparation", _prepare_sql("flows_all AS (SELECT * FROM lineitem)"))
def strict_preparation(spark: SparkSession, d: str) -> DataFrame:
    """FIT-14 / VAL-09: flows that pass validation are prepared; the dirty ones must raise."""
    try:
        PREP.fit_transform(dirty_flows(spark, d).withColumn("l_quantity", -F.col("l_quantity")), LF, KEY, "minmax", "median")
    except ValueError:
        pass
    else:
        raise AssertionError("flows with negative quantities passed validation")
    p = PREP.fit_transform(table(spark, d, "lineitem"), LF, KEY, "minmax", "median", strict=True)
    return p.data.groupBy("split", "y", "y_binary").agg(F.count(F.lit(1)).alias("rows"), *[r(F.avg(f)).alias(f) for f in p.features])


_MERGED = ["l_quantity", "l_extendedprice", "l_discount", "l_linestatus"]


@register("prepare_merged", f"""
WITH pool AS (SELECT *, CASE WHEN l_linenumber <= 3 THEN 'a' ELSE 'b' END AS dataset_source, CAST(lower(trim(l_returnflag)) NOT IN ('n') AS INTEGER) AS y_binary FROM lineitem),
{_split_sql('pool', 'y_binary', KEY, 0.8, 0.0)},
s AS (SELECT *, CASE WHEN split = 'val' THEN 'test' ELSE split END AS part FROM split_t),
code AS (SELECT l_linestatus, row_number() OVER (ORDER BY l_linestatus) - 1 AS code FROM (SELECT DISTINCT l_linestatus FROM s WHERE part = 'train')),
e AS (SELECT s.part, s.y_binary, s.l_returnflag, s.dataset_source, s.l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount,
             code.code::DOUBLE AS l_linestatus FROM s LEFT JOIN code USING (l_linestatus)),
long AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {i} AS pos, l_returnflag AS y, {f} AS x FROM e WHERE part = 'train'" for i, f in enumerate(_MERGED))}),
g AS (SELECT feature, pos, y, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM long GROUP BY ALL),
t AS (SELECT feature, sum(n) AS n, sum(n * m) / sum(n) AS m, count(*) AS k FROM g GROUP BY feature),
f AS (SELECT g.feature, any_value(g.pos) AS pos, (sum(g.n * pow(g.m - t.m, 2)) / (max(t.k) - 1)) / (sum((g.n - 1) * g.v) / (max(t.n) - max(t.k))) AS f FROM g JOIN t USING (feature) GROUP BY g.feature),
best AS (SELECT feature FROM f ORDER BY f DESC, pos LIMIT 3),
wide AS ({' UNION ALL '.join(f"SELECT part, y_binary, dataset_source, l_returnflag, '{f}' AS feature, {f} AS x FROM e" for f in _MERGED)}),
st AS (SELECT feature, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END AS sd FROM wide WHERE part = 'train' GROUP BY feature),
idx AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) - 1 AS y FROM (SELECT DISTINCT l_returnflag FROM e WHERE part = 'train'))
SELECT part AS split, dataset_source, y_binary, coalesce(y, -1) AS y, w.feature, count(*) AS rows, round(avg((x - m) / sd), 6) + 0.0 AS mean
FROM wide w JOIN best USING (feature) JOIN st USING (feature) LEFT JOIN idx USING (l_returnflag) GROUP BY ALL
""")
def prepare_merged(spark: SparkSession, d: str) -> DataFrame:
    """FIT-15: two datasets with different columns, merged, split, encoded, cut to the top features and scaled."""
    li = table(spark, d, "lineitem")
    a = li.where("l_linenumber <= 3").select(*KEY, *_MERGED, "l_tax", "l_returnflag", F.lit("a").alias("dataset_source"))
    b = li.where("l_linenumber > 3").select("l_returnflag", *KEY, *reversed(_MERGED), "l_shipdate", F.lit("b").alias("dataset_source"))
    p = PREP.prepare_merged(a, b, "l_returnflag", KEY, ["n"], top_k=3)
    long = p.data.select("split", "dataset_source", "y_binary", "y", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in p.features])).alias("e"))
    return long.groupBy("split", "dataset_source", "y_binary", "y", "e.feature").agg(F.count(F.lit(1)).alias("rows"), r(F.avg("e.x")).alias("mean"))


@register("prepare_category_stack", f"""
WITH {EVENTS_SQL}, {EVENTS_TAXONOMY_SQL},
c AS (SELECT ev.event_id, ev.event_type, {fin('ev.value')} AS value, coalesce(tax.category, 'Other') AS category
      FROM ev LEFT JOIN tax ON trim(ev.event_type) = tax.raw_label AND tax.dataset = 'events'),
cc AS (SELECT DISTINCT * FROM c WHERE value IS NOT NULL),
pool AS (SELECT * FROM cc WHERE category NOT IN ('DoS')),
{_split_sql('pool', 'category', ['event_id'], 0.8, 0.0)},
allr AS (SELECT event_id, category, value, CASE WHEN split = 'val' THEN 'test' ELSE split END AS split FROM split_t
         UNION ALL SELECT event_id, category, value, 'zero_day' FROM cc WHERE category IN ('DoS')),
p AS (SELECT avg(value) AS m, CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS s FROM allr WHERE split = 'train')
SELECT split, category, count(*) AS rows, round(avg((value - m) / s), 6) AS value FROM allr, p GROUP BY split, category
""")
def prepare_category_stack(spark: SparkSession, d: str) -> DataFrame:
    """FIT-15 / FLT-05: taxonomy categories, zero-day holdout (DoS), 80/20 stratified split,
    population z-score fitted on train."""
    ev = TAX.map_labels(dirty_events(spark, d), "event_type", "events", TAX.taxonomy(spark, EVENTS_TAXONOMY))
    ev = ev.select("event_id", "event_type", "value", "category")
    out = PREP.prepare_category_stack(ev, "event_type", ["value"], ["DoS"], ["event_id"])
    return out.groupBy("split", "category").agg(F.count(F.lit(1)).alias("rows"), r(F.avg("value")).alias("value"))


# --------------------------------------------------------------------------- FS


def _anova_sql(src: str, feats, label: str) -> str:
    per = ", ".join(f"count({fin(f)}) AS n_{f}, avg({fin(f)}) AS m_{f}, var_pop({fin(f)}) AS v_{f}" for f in feats)
    rows = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {i} AS position, CAST(n_{f} AS DOUBLE) AS n, m_{f} AS m, v_{f} AS v FROM a_per WHERE n_{f} > 0"
        for i, f in enumerate(feats))
    return f"""a_per AS (SELECT {label}, {per} FROM {src} WHERE {label} IS NOT NULL GROUP BY {label}),
a_lng AS ({rows}),
a_all AS (SELECT feature, sum(n * m) / sum(n) AS grand FROM a_lng GROUP BY feature),
a_g AS (SELECT feature, position, sum(n) AS nn, count(*) AS k, sum(n * v) AS ssw, sum(n * (m - grand) * (m - grand)) AS ssb
      FROM a_lng JOIN a_all USING (feature) GROUP BY feature, position),
anova AS (SELECT feature, position,
  CASE WHEN k > 1 THEN (ssb / (k - 1)) / nullif(ssw / nullif(nn - k, 0), 0) END AS f_score FROM a_g)"""


@register("anova_topk", f"""
WITH {_anova_sql('lineitem', FEATS, 'l_returnflag')},
rk AS (SELECT *, row_number() OVER (ORDER BY f_score DESC NULLS LAST, position) AS rn FROM anova)
SELECT feature, position, round(f_score, 4) AS f_score, rn <= 2 AS selected FROM rk
""")
def anova_topk(spark: SparkSession, d: str) -> DataFrame:
    """FS-01: ANOVA F per feature; top-2 kept in original column order."""
    a = FS.anova_f(table(spark, d, "lineitem"), FEATS, "l_returnflag")
    top = FS.select_top_k(a, 2).select("feature", F.lit(True).alias("selected"))
    return a.join(top, "feature", "left").select("feature", "position", r("f_score", 4).alias("f_score"),
                                                 F.coalesce("selected", F.lit(False)).alias("selected"))


def _mi_sql(src: str, feats, label: str, bins: int = 10) -> str:
    lng = " UNION ALL ".join(f"SELECT '{f}' AS feature, {fin(f)} AS value, {label} AS y FROM {src}" for f in feats)
    return f"""m_lng AS (SELECT * FROM ({lng}) WHERE value IS NOT NULL AND y IS NOT NULL),
m_rng AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM m_lng GROUP BY feature),
m_b AS (SELECT l.feature, l.y, CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((value - lo) / ((hi - lo) / {bins})) AS INTEGER), {bins - 1}) END AS bin
      FROM m_lng l JOIN m_rng USING (feature)),
m_j AS (SELECT feature, bin, y, count(*) AS nxy FROM m_b GROUP BY ALL),
m_nx AS (SELECT feature, bin, sum(nxy) AS nx FROM m_j GROUP BY ALL),
m_ny AS (SELECT feature, y, sum(nxy) AS ny FROM m_j GROUP BY ALL),
m_n AS (SELECT feature, sum(nxy) AS n FROM m_j GROUP BY ALL),
mi AS (SELECT m_j.feature, sum((CAST(nxy AS DOUBLE) / n) * ln((CAST(nxy AS DOUBLE) * n) / (CAST(nx AS DOUBLE) * ny))) AS mutual_info
       FROM m_j JOIN m_nx USING (feature, bin) JOIN m_ny USING (feature, y) JOIN m_n USING (feature) GROUP BY m_j.feature)"""


@register("mutual_info", f"WITH {_mi_sql('lineitem', FEATS, 'l_returnflag')}\nSELECT feature, round(mutual_info, 6) AS mutual_info FROM mi")
def mutual_info(spark: SparkSession, d: str) -> DataFrame:
    """FS-03 (re-aimed): binned mutual information (10 equal-width bins, nats)."""
    return FS.mutual_information(table(spark, d, "lineitem"), FEATS, "l_returnflag", 10, digits=6)


@register("combined_rank", f"""
WITH {_anova_sql('lineitem', FEATS, 'l_returnflag')}, {_mi_sql('lineitem', FEATS, 'l_returnflag')},
ra AS (SELECT feature, rank() OVER (ORDER BY f_score DESC) + (count(*) OVER (PARTITION BY f_score) - 1) / 2.0 AS rank_a FROM anova),
rb AS (SELECT feature, rank() OVER (ORDER BY round(mutual_info, 6) DESC) + (count(*) OVER (PARTITION BY round(mutual_info, 6)) - 1) / 2.0 AS rank_b FROM mi)
SELECT feature, CAST(rank_a AS DOUBLE) AS rank_a, CAST(rank_b AS DOUBLE) AS rank_b, CAST((rank_a + rank_b) / 2.0 AS DOUBLE) AS combined_rank
FROM ra JOIN rb USING (feature)
""")
def combined_rank(spark: SparkSession, d: str) -> DataFrame:
    """FS-04 / WIN-01 / JOIN-03: mean of two descending average-tie ranks (ANOVA F, MI)."""
    li = table(spark, d, "lineitem")
    a = FS.anova_f(li, FEATS, "l_returnflag")
    b = FS.mutual_information(li, FEATS, "l_returnflag", 10, digits=6)
    return FS.combined_rank(a, b, "f_score", "mutual_info").select(
        "feature", F.col("rank_a").cast("double"), F.col("rank_b").cast("double"), F.col("combined_rank").cast("double"))


def _auc_sql(src: str, feats, label: str) -> str:
    lng = " UNION ALL ".join(f"SELECT '{f}' AS feature, {fin(f)} AS value, CAST({label} AS VARCHAR) AS y FROM {src}" for f in feats)
    return f"""lng AS (SELECT * FROM ({lng}) WHERE value IS NOT NULL AND y IS NOT NULL),
rk AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY value)
                          + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS ar FROM lng),
tot AS (SELECT feature, count(*) AS n FROM lng GROUP BY feature),
per AS (SELECT feature, y, sum(ar) AS rs, count(*) AS p FROM rk GROUP BY feature, y),
auc AS (SELECT per.feature, y, (rs - p * (p + 1) / 2.0) / nullif(CAST(p AS DOUBLE) * (n - p), 0) AS auc
        FROM per JOIN tot USING (feature))"""


@register("separability_auc", f"""
WITH {_auc_sql('lineitem', FEATS, 'l_returnflag')},
best AS (SELECT feature, max(greatest(auc, 1 - auc)) AS auc FROM auc WHERE auc IS NOT NULL GROUP BY feature)
SELECT feature, round(auc, 4) AS auc, auc >= 0.98 AS flagged FROM best
""")
def separability_auc(spark: SparkSession, d: str) -> DataFrame:
    """FS-05 / WIN-05: single-feature one-vs-rest AUC (rank-sum with ties), max over classes."""
    return FS.single_feature_separability(table(spark, d, "lineitem"), FEATS, "l_returnflag")


def _shift_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, avg(CASE WHEN l_returnflag <> 'R' THEN {f} END) AS m, "
        f"stddev_samp(CASE WHEN l_returnflag <> 'R' THEN {f} END) AS s, avg(CASE WHEN l_returnflag = 'R' THEN {f} END) AS z FROM lineitem"
        for f in FEATS)
    return f"""sh AS (SELECT feature, CASE WHEN s = 0 OR s IS NULL THEN 0.0 ELSE round(abs(z - m) / s, 3) END AS distribution_shift
                FROM ({parts}))"""


@register("zero_day_shift", f"WITH {_shift_sql()}\nSELECT * FROM sh")
def zero_day_shift(spark: SparkSession, d: str) -> DataFrame:
    """FS-07: return flag R held out as the 'zero-day' family; standardized mean shift."""
    li = table(spark, d, "lineitem")
    return FS.zero_day_shift(li.where(F.col("l_returnflag") != "R"), li.where(F.col("l_returnflag") == "R"), FEATS)


def _spoof_sql(x: str) -> str:
    agg = " OR ".join(f"instr(lower({x}), '{p}') > 0" for p in C.AGGREGATE_PATTERNS)
    ctl = " OR ".join(f"instr(lower({x}), '{p}') > 0" for p in C.ATTACKER_CONTROLLABLE_PATTERNS)
    return (f"CASE WHEN {agg} THEN '{C.SPOOF_AGGREGATE}' WHEN {ctl} THEN '{C.SPOOF_CONTROLLABLE}' "
            f"ELSE '{C.SPOOF_UNCLASSIFIED}' END")


_RISK_SQL = f"""{_anova_sql('lineitem', FEATS, 'l_returnflag')}, {_shift_sql()},
imp AS (SELECT feature, f_score / CASE WHEN max(f_score) OVER () = 0 THEN 1.0 ELSE max(f_score) OVER () END AS ni FROM anova),
sp AS (SELECT feature, ni, {_spoof_sql('feature')} AS spoofability FROM imp),
risk AS (SELECT sp.feature, round(ni, 4) AS importance, spoofability, sh.distribution_shift,
        round(ni * CASE spoofability WHEN '{C.SPOOF_CONTROLLABLE}' THEN 1.0 WHEN '{C.SPOOF_UNCLASSIFIED}' THEN 0.5 ELSE 0.2 END, 4) AS risk_score
        FROM sp LEFT JOIN sh USING (feature))"""


def _risk(spark, d):
    li = table(spark, d, "lineitem")
    imp = FS.anova_f(li, FEATS, "l_returnflag").select("feature", F.col("f_score").alias("importance"))
    shifts = FS.zero_day_shift(li.where(F.col("l_returnflag") != "R"), li.where(F.col("l_returnflag") == "R"), FEATS)
    return FS.security_risk(imp, None, shifts)


@register("security_risk", f"WITH {_RISK_SQL}\nSELECT feature, importance, spoofability, distribution_shift, risk_score FROM risk")
def security_risk(spark: SparkSession, d: str) -> DataFrame:
    """FS-08 / FS-09 / JOIN-02 / WIN-04: ANOVA importance (normalised by max) x spoofability weight."""
    return _risk(spark, d).select("feature", "importance", "spoofability", "distribution_shift", "risk_score")


@register("risk_findings", f"""
WITH {_RISK_SQL},
t AS (SELECT *, row_number() OVER (ORDER BY risk_score DESC, feature) AS rn FROM risk),
t20 AS (SELECT * FROM t WHERE rn <= 20)
SELECT 'controllable_and_important' AS finding, count(*) AS n_features,
       coalesce(array_to_string(list(feature ORDER BY rn)[1:5], ','), '') AS examples
FROM t20 WHERE spoofability = '{C.SPOOF_CONTROLLABLE}' AND importance > 0.3
UNION ALL SELECT 'easily_flipped', 0, ''
UNION ALL SELECT 'zero_day_shift', count(*), coalesce(array_to_string(list(feature ORDER BY rn)[1:5], ','), '')
FROM t20 WHERE distribution_shift > 1.0
""")
def risk_findings(spark: SparkSession, d: str) -> DataFrame:
    """FS-10: finding rows over the top-20 risk features (no model: flip rule is empty)."""
    f = FS.risk_findings(_risk(spark, d))
    return f.select("finding", "n_features", F.array_join("examples", ",").alias("examples"))


@register("feature_reliance", f"""
WITH src AS (SELECT l_returnflag, CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_suppkey AS DOUBLE) AS l_suppkey,
                    CAST(epoch(l_shipdate) AS DOUBLE) AS l_shipdate, {', '.join(FEATS)} FROM lineitem),
{_mi_sql('src', ['l_orderkey', 'l_suppkey', 'l_shipdate'] + FEATS, 'l_returnflag')},
t AS (SELECT feature, round(mutual_info, 6) AS importance FROM mi ORDER BY importance DESC, feature LIMIT 15)
SELECT feature, importance,
  {' OR '.join(f"instr(lower(feature), '{p}') > 0" for p in C.IDENTITY_LEAK_PATTERNS)} AS identity_like,
  regexp_matches(feature, '{C.IDENTITY_NAME_REGEX.replace("(?i)", "")}', 'i') AS identity_like_token FROM t
""")
def feature_reliance(spark: SparkSession, d: str) -> DataFrame:
    """FS-11 / FLT-10 / FLT-11: top-15 features by (binned MI) importance with identity flags."""
    li = table(spark, d, "lineitem").select(
        "l_returnflag", F.col("l_orderkey").cast("double").alias("l_orderkey"),
        F.col("l_suppkey").cast("double").alias("l_suppkey"),
        F.unix_timestamp("l_shipdate").cast("double").alias("l_shipdate"), *FEATS)
    feats = ["l_orderkey", "l_suppkey", "l_shipdate"] + FEATS
    mi = FS.mutual_information(li, feats, "l_returnflag", 10, digits=6).withColumnRenamed("mutual_info", "importance")
    top = FS.feature_reliance(mi, 15, regex=False)
    from ..functions.text import identity_like_regex
    return top.withColumn("identity_like_token", identity_like_regex(F.col("feature")))


# --------------------------------------------------------------------------- TAX


@register("taxonomy_map", f"""
WITH {EVENTS_TAXONOMY_SQL}
SELECT e.event_type, coalesce(tax.category, 'Other') AS category, coalesce(tax.severity, 'medium') AS severity, count(*) AS rows
FROM events e LEFT JOIN tax ON trim(e.event_type) = tax.raw_label AND tax.dataset = 'events' GROUP BY 1, 2, 3
""")
def taxonomy_map(spark: SparkSession, d: str) -> DataFrame:
    """TAX-01 / TAX-02 / JOIN-01: label -> category (else Other) and severity (else medium)."""
    ev = TAX.map_labels(table(spark, d, "events"), "event_type", "events", TAX.taxonomy(spark, EVENTS_TAXONOMY))
    return ev.groupBy("event_type", "category", "severity").agg(F.count(F.lit(1)).alias("rows"))


@register("family_consolidation", """
WITH m AS (SELECT n.n_name AS raw_label, r.r_name AS family FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)
SELECT coalesce(m.family, trim(n.n_name)) AS family, count(*) AS rows
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN m ON trim(n.n_name) = m.raw_label
GROUP BY 1
""")
def family_consolidation(spark: SparkSession, d: str) -> DataFrame:
    """TAX-03: sub-label -> family map (here nation -> region, derived from the tables); unknown passes."""
    nat = table(spark, d, "nation")
    fam = nat.join(table(spark, d, "region"), nat.n_regionkey == F.col("r_regionkey")).select(
        F.col("n_name").alias("raw_label"), F.col("r_name").alias("family"))
    cust = table(spark, d, "customer").join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
    out = TAX.consolidate_with(cust, "n_name", fam, out="family")
    return out.groupBy("family").agg(F.count(F.lit(1)).alias("rows"))


@register("taxonomy_coverage", f"""
WITH {EVENTS_TAXONOMY_SQL}
SELECT DISTINCT trim(event_type) AS label FROM events
WHERE trim(event_type) NOT IN (SELECT raw_label FROM tax WHERE dataset = 'events')
""")
def taxonomy_coverage(spark: SparkSession, d: str) -> DataFrame:
    """TAX-04 / SET-04 / JOIN-06: labels seen but not in the taxonomy."""
    return TAX.coverage_gaps(table(spark, d, "events"), "event_type", "events", TAX.taxonomy(spark, EVENTS_TAXONOMY))


@register("taxonomy_listing", f"""
WITH {EVENTS_TAXONOMY_SQL},
cat AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{s}')" for c, s in C.DEFAULT_SEVERITY_BY_CATEGORY)}) AS t(category, default_severity)),
seen AS (SELECT event_type, count(*) AS rows FROM events GROUP BY 1)
SELECT tax.category, tax.raw_label, tax.severity, cat.default_severity, coalesce(seen.rows, 0) AS rows
FROM tax JOIN cat USING (category) LEFT JOIN seen ON seen.event_type = tax.raw_label WHERE tax.dataset = 'events'
""")
def taxonomy_listing(spark: SparkSession, d: str) -> DataFrame:
    """TAX-05 / TAX-06: taxonomy for one dataset with default severity and observed rows."""
    tax = TAX.taxonomy_for_dataset(TAX.taxonomy(spark, EVENTS_TAXONOMY), "events")
    cats = TAX.categories(spark).select("category", "default_severity")
    seen = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))
    out = tax.join(F.broadcast(cats), "category").join(seen, F.col("raw_label") == F.col("event_type"), "left")
    return out.select("category", "raw_label", "severity", "default_severity",
                      F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"))


__all__ = ["finite", "SH"]
