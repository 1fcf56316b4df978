"""Registered queries: evaluation (EVAL-*) and scoring / triage (SCR-*).

The scored table is a deterministic rule classifier over lineitem (truth =
return flag) or a softmax over event features, so every metric is checkable
against plain SQL.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import arrays as A
from ..operators import evaluate as EV
from ..operators import fit as FIT
from ..operators import labels as TAX
from ..operators import score as SCR
from ..operators import shape as SH
from ..operators import split as SPL
from .catalog import _split_sql
from .registry import FEATS, KEY, r, register
from .tables import EVENTS_TAXONOMY, EVENTS_TAXONOMY_SQL, table

RULE_SQL = ("CASE WHEN l_discount >= 0.07 THEN 'R' WHEN l_tax >= 0.05 THEN 'A' ELSE 'N' END")
SCORED_SQL = f"scored AS (SELECT *, l_returnflag AS truth, {RULE_SQL} AS prediction FROM lineitem)"
CM_SQL = SCORED_SQL + ",\ncm AS (SELECT truth, prediction, count(*) AS count FROM scored GROUP BY 1, 2)"
PC_SQL = CM_SQL + """,
tp AS (SELECT truth AS cls, count AS tp FROM cm WHERE truth = prediction),
sup AS (SELECT truth AS cls, sum(count) AS support FROM cm GROUP BY 1),
prd AS (SELECT prediction AS cls, sum(count) AS predicted FROM cm GROUP BY 1),
pc0 AS (SELECT coalesce(sup.cls, prd.cls) AS cls, CAST(coalesce(tp.tp, 0) AS BIGINT) AS tp,
               CAST(coalesce(sup.support, 0) AS BIGINT) AS support, CAST(coalesce(prd.predicted, 0) AS BIGINT) AS predicted
        FROM sup FULL JOIN prd ON sup.cls = prd.cls LEFT JOIN tp ON tp.cls = coalesce(sup.cls, prd.cls)),
pc1 AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0.0) AS precision,
                  coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0.0) AS recall FROM pc0),
pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pc1)"""


def rule_scored(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    pred = (F.when(F.col("l_discount") >= 0.07, "R").when(F.col("l_tax") >= 0.05, "A").otherwise("N"))
    return li.withColumn("truth", F.col("l_returnflag")).withColumn("prediction", pred)


def _cm(spark, d):
    return EV.confusion(rule_scored(spark, d), "truth", "prediction")


@register("confusion_matrix", CM_SQL.replace("scored AS", "WITH scored AS", 1) + """, lab AS (SELECT truth AS l FROM cm UNION SELECT prediction FROM cm)
SELECT a.l AS truth, b.l AS prediction, coalesce(count, 0) AS count
FROM lab a CROSS JOIN lab b LEFT JOIN cm ON cm.truth = a.l AND cm.prediction = b.l""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """EVAL-01: the full grid of truth and prediction, zero cells included."""
    return EV.confusion_grid(_cm(spark, d))


@register("per_class_metrics", "WITH " + PC_SQL + """
SELECT cls, tp, support, predicted, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1 FROM pc""")
def per_class_metrics(spark: SparkSession, d: str) -> DataFrame:
    """EVAL-06: per class over labels U predictions, zero division -> 0, 4 dp."""
    return EV.per_class(_cm(spark, d))


@register("summary_metrics", "WITH " + PC_SQL + """
SELECT round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS accuracy,
  round(avg(CASE WHEN support > 0 THEN recall END), 6) AS balanced_accuracy,
  round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro,
  round(sum(precision * support) / sum(support), 6) AS precision_weighted,
  round(sum(recall * support) / sum(support), 6) AS recall_weighted,
  round(sum(f1 * support) / sum(support), 6) AS f1_weighted, CAST(sum(support) AS BIGINT) AS total_samples FROM pc""")
def summary_metrics(spark: SparkSession, d: str) -> DataFrame:
    """EVAL-02 / EVAL-03: accuracy, balanced accuracy, macro and weighted P/R/F1."""
    s = EV.summary(_cm(spark, d))
    return s.select(*[r(c).alias(c) for c in s.columns if c != "total_samples"],
                    F.col("total_samples").cast("bigint").alias("total_samples"))


@register("error_rates", "WITH " + CM_SQL + """,
a AS (SELECT sum(CASE WHEN truth = 'N' AND prediction = 'N' THEN count ELSE 0 END) AS c00,
             sum(CASE WHEN truth = 'N' THEN count ELSE 0 END) AS row0,
             sum(CASE WHEN prediction = 'N' THEN count ELSE 0 END) AS col0, sum(count) AS n FROM cm)
SELECT round(coalesce(CAST(col0 - c00 AS DOUBLE) / nullif(n - row0, 0), 0.0), 6) AS fpr_reference,
       round(coalesce(CAST(row0 - c00 AS DOUBLE) / nullif(row0, 0), 0.0), 6) AS fnr_reference,
       round(coalesce(CAST(row0 - c00 AS DOUBLE) / nullif(row0, 0), 0.0), 6) AS fpr,
       round(coalesce(CAST(col0 - c00 AS DOUBLE) / nullif(n - row0, 0), 0.0), 6) AS fnr FROM a""")
def error_rates(spark: SparkSession, d: str) -> DataFrame:
    """EVAL-04: the compatible class-0 forms and the true FPR / FNR (benign = N)."""
    e = EV.error_rates(_cm(spark, d), "N")
    return e.select(*[r(c).alias(c) for c in e.columns])


@register("classification_report", "WITH " + PC_SQL + """
SELECT cls AS "row", round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM pc
UNION ALL SELECT 'accuracy', NULL, NULL, round(CAST(sum(tp) AS DOUBLE) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4), round(sum(recall * support) / sum(support), 4),
                 round(sum(f1 * support) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM pc""")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    """EVAL-07."""
    rep = EV.classification_report(_cm(spark, d))
    return rep.select("row", "precision", "recall", "f1", F.col("support").cast("bigint").alias("support"))


def _rank_auc_sql(src: str, score: str, pos: str) -> str:
    return f"""a_in AS (SELECT {score} AS s, CAST({pos} AS INTEGER) AS y FROM {src} WHERE {score} IS NOT NULL),
a_rk AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS ar FROM a_in),
a_out AS (SELECT (sum(CASE WHEN y = 1 THEN ar END) - sum(y) * (sum(y) + 1) / 2.0)
                 / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y))) AS auc FROM a_rk)"""


@register("roc_auc_binary", "WITH " + _rank_auc_sql("lineitem", "l_discount + l_tax", "l_returnflag = 'R'")
          + "\nSELECT round(auc, 6) AS auc FROM a_out")
def roc_auc_binary(spark: SparkSession, d: str) -> DataFrame:
    """EVAL-05 (binary): rank-sum AUC of discount + tax for the R class."""
    li = table(spark, d, "lineitem").withColumn("score", F.col("l_discount") + F.col("l_tax"))
    return EV.binary_auc(li, "l_returnflag", "score", "R").select(r("auc").alias("auc"))


# Normalised linear scores (no exp): IEEE-exact in both engines, so rank ties agree.
_SOFT_SQL = """sm0 AS (SELECT l_returnflag, l_discount + 0.01 AS x0, l_tax + 0.01 AS x1, l_quantity / 50 AS x2 FROM lineitem),
sm AS (SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS t,
              x0 / (x0 + x1 + x2) AS p0, x1 / (x0 + x1 + x2) AS p1, x2 / (x0 + x1 + x2) AS p2 FROM sm0)"""


@register("roc_auc_ovr", f"""
WITH {_SOFT_SQL},
lng AS (SELECT 0 AS cls, p0 AS s, CAST(t = 0 AS INTEGER) AS y FROM sm UNION ALL SELECT 1, p1, CAST(t = 1 AS INTEGER) FROM sm
        UNION ALL SELECT 2, p2, CAST(t = 2 AS INTEGER) FROM sm),
rk AS (SELECT cls, y, rank() OVER (PARTITION BY cls ORDER BY s) + (count(*) OVER (PARTITION BY cls, s) - 1) / 2.0 AS ar FROM lng),
per AS (SELECT cls, (sum(CASE WHEN y = 1 THEN ar END) - sum(y) * (sum(y) + 1) / 2.0) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y))) AS auc
        FROM rk GROUP BY cls)
SELECT round(avg(auc), 6) AS roc_auc_ovr_macro, count(auc) AS classes FROM per
""")
def roc_auc_ovr(spark: SparkSession, d: str) -> DataFrame:
    """EVAL-05 (multiclass): one-vs-rest macro AUC from a softmax probability array."""
    li = table(spark, d, "lineitem")
    idx = FIT.fit_label_index(li, "l_returnflag")
    li = FIT.apply_label_index(li, idx, "l_returnflag", "t")
    x = F.array(F.col("l_discount") + 0.01, F.col("l_tax") + 0.01, F.col("l_quantity") / 50)
    li = li.withColumn("prob", F.transform(x, lambda v: v / A.array_sum(x)))
    out = EV.ovr_macro_auc(li, "t", "prob")
    return out.select(r("roc_auc_ovr_macro").alias("roc_auc_ovr_macro"), "classes")


@register("average_precision", """
WITH v AS (SELECT l_discount + l_tax AS s, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS pos,
                  sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS neg FROM lineitem GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS p FROM v)
SELECT round(sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) / max(p), 6) AS average_precision FROM c
""")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    """EVAL-12: PR-AUC as step-wise average precision (distributed cumulative counts)."""
    li = table(spark, d, "lineitem").withColumn("score", F.col("l_discount") + F.col("l_tax"))
    return EV.average_precision(li, "l_returnflag", "score", "R").select(r("average_precision").alias("average_precision"))


@register("missed_as_normal", SCORED_SQL.replace("scored AS", "WITH scored AS", 1) + """
SELECT l_linestatus, CAST(sum(CASE WHEN truth NOT IN ('N') THEN 1 ELSE 0 END) AS BIGINT) AS attacks,
  CAST(sum(CASE WHEN truth NOT IN ('N') AND prediction IN ('N') THEN 1 ELSE 0 END) AS BIGINT) AS missed,
  round(CAST(sum(CASE WHEN truth NOT IN ('N') AND prediction IN ('N') THEN 1 ELSE 0 END) AS DOUBLE)
        / sum(CASE WHEN truth NOT IN ('N') THEN 1 ELSE 0 END), 6) AS missed_as_normal_rate
FROM scored GROUP BY l_linestatus""")
def missed_as_normal(spark: SparkSession, d: str) -> DataFrame:
    """EVAL-09: attacks predicted benign over all attacks, per group (line status as 'model')."""
    m = EV.missed_as_normal(rule_scored(spark, d), "truth", "prediction", ["N"], by=["l_linestatus"])
    return m.select("l_linestatus", F.col("attacks").cast("bigint"), F.col("missed").cast("bigint"),
                    r("missed_as_normal_rate").alias("missed_as_normal_rate"))


@register("dangerous_misses", SCORED_SQL.replace("scored AS", "WITH scored AS", 1) + """
SELECT truth AS attack_class, count(*) AS total, CAST(sum(CASE WHEN prediction IN ('N') THEN 1 ELSE 0 END) AS BIGINT) AS missed,
  round(100.0 * CAST(sum(CASE WHEN prediction IN ('N') THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 2) AS miss_rate_pct
FROM scored WHERE truth NOT IN ('N') GROUP BY truth""")
def dangerous_misses(spark: SparkSession, d: str) -> DataFrame:
    """EVAL-10: per attack class total, missed-as-benign and miss rate %."""
    m = EV.dangerous_misses(rule_scored(spark, d), "truth", "prediction", ["N"])
    return m.select("attack_class", "total", F.col("missed").cast("bigint"), "miss_rate_pct")


@register("worst_attack_class", SCORED_SQL.replace("scored AS", "WITH scored AS", 1) + """,
m AS (SELECT truth AS attack_class, count(*) AS total,
             round(100.0 * CAST(sum(CASE WHEN prediction IN ('N') THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 2) AS miss_rate_pct
      FROM scored WHERE truth NOT IN ('N') GROUP BY truth)
SELECT arg_max(attack_class, (miss_rate_pct, total, attack_class)) AS worst_class, max(miss_rate_pct) AS worst_miss_rate_pct FROM m""")
def worst_attack_class(spark: SparkSession, d: str) -> DataFrame:
    """EVAL-10 / SORT-04: the attack class with the highest miss rate (max_by)."""
    return EV.worst_class(EV.dangerous_misses(rule_scored(spark, d), "truth", "prediction", ["N"]))


@register("zero_day_detection", SCORED_SQL.replace("scored AS", "WITH scored AS", 1) + """,
a AS (SELECT count(*) AS total, CAST(sum(CASE WHEN prediction NOT IN ('N') THEN 1 ELSE 0 END) AS BIGINT) AS flagged
      FROM scored WHERE truth = 'R')
SELECT total, flagged, total - flagged AS missed, round(100.0 * CAST(flagged AS DOUBLE) / total, 2) AS detection_rate_pct FROM a""")
def zero_day_detection(spark: SparkSession, d: str) -> DataFrame:
    """EVAL-11: the R family held out as 'zero-day': flagged / missed / detection rate."""
    s = rule_scored(spark, d)
    z = EV.zero_day_detection(s.where(F.col("truth") == "R"), "prediction", ["N"])
    return z.select("total", F.col("flagged").cast("bigint"), F.col("missed").cast("bigint"), "detection_rate_pct")


@register("predicted_distribution", SCORED_SQL.replace("scored AS", "WITH scored AS", 1) + """
SELECT prediction, count(*) AS count FROM scored WHERE truth = 'R' GROUP BY prediction""")
def predicted_distribution(spark: SparkSession, d: str) -> DataFrame:
    """EVAL-11 / AGG-02: predicted-label distribution on the held-out family."""
    from ..operators.stats import value_counts
    return value_counts(rule_scored(spark, d).where(F.col("truth") == "R"), "prediction")


@register("split_metrics", f"""
WITH {_split_sql('lineitem', 'l_returnflag', KEY)}
SELECT split, round(avg(CASE WHEN l_returnflag = ({RULE_SQL}) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS rows
FROM split_t GROUP BY split""")
def split_metrics(spark: SparkSession, d: str) -> DataFrame:
    """EVAL-13: accuracy per split."""
    s = SPL.stratified_split(rule_scored(spark, d), "l_returnflag", KEY)
    m = EV.split_metrics(s, "split", "truth", "prediction")
    return m.select("split", r("accuracy").alias("accuracy"), "rows")


def _model_metrics_sql(name: str, rule: str) -> str:
    return f"""SELECT '{name}' AS model, count(*) AS n, t, p, count(*) AS c FROM (
      SELECT l_returnflag AS t, {rule} AS p FROM lineitem) GROUP BY t, p"""


@register("compare_models", f"""
WITH cm AS ({_model_metrics_sql('rule_a', RULE_SQL)} UNION ALL
            {_model_metrics_sql('rule_b', "CASE WHEN l_discount >= 0.05 THEN 'R' ELSE 'N' END")}),
sup AS (SELECT model, t AS cls, sum(c) AS support FROM cm GROUP BY 1, 2),
prd AS (SELECT model, p AS cls, sum(c) AS predicted FROM cm GROUP BY 1, 2),
tp AS (SELECT model, t AS cls, c AS tp FROM cm WHERE t = p),
pc0 AS (SELECT coalesce(sup.model, prd.model) AS model, coalesce(sup.cls, prd.cls) AS cls, coalesce(tp.tp, 0) AS tp,
               coalesce(sup.support, 0) AS support, coalesce(prd.predicted, 0) AS predicted
        FROM sup FULL JOIN prd ON sup.model = prd.model AND sup.cls = prd.cls
        LEFT JOIN tp ON tp.model = coalesce(sup.model, prd.model) AND tp.cls = coalesce(sup.cls, prd.cls)),
pc1 AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0.0) AS pr, coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0.0) AS rc FROM pc0),
pc AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM pc1),
s AS (SELECT model, CAST(sum(tp) AS DOUBLE) / sum(support) AS acc, avg(f1) AS f1m, avg(pr) AS pm, avg(rc) AS rm FROM pc GROUP BY model),
e AS (SELECT model, coalesce(CAST(sum(CASE WHEN t = 'N' AND p <> 'N' THEN c ELSE 0 END) AS DOUBLE)
                     / nullif(sum(CASE WHEN t = 'N' THEN c ELSE 0 END), 0), 0.0) AS fpr FROM cm GROUP BY model)
SELECT s.model AS "Model", printf('%.2f', acc * 100) || '%' AS "Accuracy", printf('%.2f', f1m * 100) || '%' AS "F1-Macro",
  printf('%.2f', pm * 100) || '%' AS "Precision", printf('%.2f', rm * 100) || '%' AS "Recall",
  printf('%.2f', fpr * 100) || '%' AS "FPR", 'N/A' AS "ROC-AUC", 'N/A' AS "p95 Latency", 'N/A' AS "Throughput"
FROM s JOIN e USING (model)
""")
def compare_models(spark: SparkSession, d: str) -> DataFrame:
    """EVAL-08: formatted comparison table for two rule models (no timings -> N/A)."""
    s = rule_scored(spark, d)
    rows = []
    for name, pred in (("rule_a", F.col("prediction")),
                       ("rule_b", F.when(F.col("l_discount") >= 0.05, "R").otherwise("N"))):
        cm = EV.confusion(s.withColumn("__p", pred), "truth", "__p")
        summ = EV.summary(cm).select("accuracy", "f1_macro", "precision_macro", "recall_macro",
                                     F.lit(None).cast("double").alias("fpr"))
        er = EV.error_rates(cm, "N").select(*[F.lit(None).cast("double").alias(c) for c in
                                               ("accuracy", "f1_macro", "precision_macro", "recall_macro")], "fpr")
        # two one-row aggregates folded by union + max (no join)
        m = summ.unionByName(er).agg(*[F.max(c).alias(c) for c in summ.columns]).select(
            F.lit(name).alias("model"), "accuracy", "f1_macro", "precision_macro", "recall_macro", "fpr",
            F.lit(None).cast("double").alias("roc_auc"), F.lit(None).cast("double").alias("p95_ms"),
            F.lit(None).cast("double").alias("rows_per_sec"))
        rows.append(m)
    return EV.compare_models(rows[0].unionByName(rows[1]))


# --------------------------------------------------------------------------- SCR

_EMB_SQL = """e AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x,
                  generate_subscripts(embedding, 1) AS i FROM embeddings)"""


@register("anomaly_scores", f"""
WITH {_EMB_SQL},
c AS (SELECT i, avg(x) AS m FROM e WHERE label = 0 GROUP BY i),
err AS (SELECT e.vec_id, e.label, avg((e.x - c.m) * (e.x - c.m)) AS err FROM e JOIN c USING (i) GROUP BY e.vec_id, e.label),
thr AS (SELECT quantile_cont(err, 0.99) AS t FROM err WHERE label = 0),
sc AS (SELECT label, tanh(err / greatest(t, 1e-6)) AS score FROM err, thr)
SELECT label, count(*) AS rows, round(avg(score), 6) AS mean_score, CAST(sum(CASE WHEN score >= 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS flagged
FROM sc GROUP BY label
""")
def anomaly_scores(spark: SparkSession, d: str) -> DataFrame:
    """SCR-02/03/04 + AGG-08 + FLT-08: centroid reconstruction fitted on benign (label 0)
    rows, p99 benign error as threshold, tanh anomaly score."""
    emb = table(spark, d, "embeddings")
    cent = SCR.fit_centroids(emb.where(F.col("label") == 0), "embedding")
    err = SCR.reconstruction_error(emb, "embedding", cent)
    thr = SCR.calibrate_threshold(err.where(F.col("label") == 0), "recon_error", 0.99)
    sc = err.withColumn("score", SCR.anomaly_score(F.col("recon_error"), thr))
    return sc.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), r(F.avg("score")).alias("mean_score"),
                                   F.sum((F.col("score") >= 0.7).cast("int")).cast("bigint").alias("flagged"))


_TRIAGE_SQL = f"""x AS (SELECT event_id, value, value / 100.0 AS a, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 50.0 AS b,
                  1.0 AS c FROM events),
m AS (SELECT *, greatest(a, b, c) AS mx FROM x),
ex AS (SELECT *, exp(a - mx) AS ea, exp(b - mx) AS eb, exp(c - mx) AS ec FROM m),
p AS (SELECT *, ea / (ea + eb + ec) AS pa, eb / (ea + eb + ec) AS pb, ec / (ea + eb + ec) AS pc FROM ex),
q AS (SELECT *, CASE WHEN pa >= pb AND pa >= pc THEN 'BENIGN' WHEN pb >= pc THEN 'DDoS' ELSE 'PortScan' END AS pred,
             round(greatest(pa, pb, pc), 4) AS conf, round(tanh(value / 250.0), 4) AS anom,
             round(-(least(greatest(pa, 1e-12), 1.0) * ln(least(greatest(pa, 1e-12), 1.0))
                    + least(greatest(pb, 1e-12), 1.0) * ln(least(greatest(pb, 1e-12), 1.0))
                    + least(greatest(pc, 1e-12), 1.0) * ln(least(greatest(pc, 1e-12), 1.0))) / ln(3), 4) AS entropy FROM p),
t AS (SELECT *, upper(pred) IN ('BENIGN', 'BENIGN_FINAL', 'NORMAL') AS benign, anom >= 0.7 AS anomalous, conf >= 0.85 AS high FROM q),
tr AS (SELECT *,
  CASE WHEN benign AND anomalous THEN 'ZERO_DAY_SUSPECT' WHEN NOT benign AND high THEN CASE WHEN anom >= 0.5 THEN 'CRITICAL' ELSE 'HIGH' END
       WHEN NOT benign THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN benign AND anomalous THEN 'QUARANTINE_FOR_ANALYSIS' WHEN NOT benign AND high THEN 'BLOCK_IMMEDIATE'
       WHEN NOT benign THEN 'INSPECT_PACKET_TRACE' ELSE 'ALLOW' END AS action,
  CASE WHEN benign AND anomalous THEN '{C.SUSPECTED_ZERO_DAY}' ELSE pred END AS classification,
  CASE WHEN benign AND anom >= 0.7 THEN '{C.SUSPECTED_ANOMALY}' ELSE pred END AS hybrid FROM t)"""


def _triaged_events(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    ev = ev.withColumn("__k", F.get_json_object("props", "$.k").cast("double"))
    ev = A.with_softmax(ev, F.array(F.col("value") / 100.0, F.col("__k") / 50.0, F.lit(1.0)), "prob")
    ev = SCR.prediction_confidence(ev, "prob", ["BENIGN", "DDoS", "PortScan"], "pred", "conf")
    ev = ev.withColumn("anom", F.round(F.tanh(F.col("value") / 250.0), 4))
    ev = ev.withColumn("hybrid", SCR.hybrid_label(F.col("pred"), F.col("anom"), 0.70))
    return SCR.triage(ev, "pred", "conf", "anom", prob="prob")


@register("triage_events", f"""
WITH {_TRIAGE_SQL}
SELECT severity, action, classification, hybrid, count(*) AS rows, round(avg(entropy), 6) AS mean_entropy,
       CAST(sum(CASE WHEN severity IN ('CRITICAL', 'HIGH', 'ZERO_DAY_SUSPECT', 'MEDIUM') THEN 1 ELSE 0 END) AS BIGINT) AS alerts
FROM tr GROUP BY ALL
""")
def triage_events(spark: SparkSession, d: str) -> DataFrame:
    """SCR-01 / SCR-05 / SCR-06 / SCR-07: softmax scoring, confidence, hybrid rule, entropy and triage."""
    t = _triaged_events(spark, d)
    return t.groupBy("severity", "action", "classification", "hybrid").agg(
        F.count(F.lit(1)).alias("rows"), r(F.avg("entropy")).alias("mean_entropy"),
        F.sum(F.col("is_alert").cast("int")).cast("bigint").alias("alerts"))


@register("focal_loss", f"""
WITH {_EMB_SQL},
c AS (SELECT label AS class, i, avg(x) AS m FROM e GROUP BY label, i),
g AS (SELECT e.vec_id, e.label, c.class, -sum((e.x - c.m) * (e.x - c.m)) AS lg FROM e JOIN c USING (i) GROUP BY ALL),
m AS (SELECT vec_id, max(lg) AS mx FROM g GROUP BY vec_id),
z AS (SELECT g.vec_id, g.label, max(CASE WHEN g.class = g.label THEN lg END) - (any_value(mx) + ln(sum(exp(lg - mx)))) AS lp
      FROM g JOIN m USING (vec_id) GROUP BY g.vec_id, g.label)
SELECT label, count(*) AS rows, round(avg(-pow(1.0 - exp(lp), 2.0) * lp), 6) AS mean_loss,
       round(sum(-pow(1.0 - exp(lp), 2.0) * lp), 4) AS sum_loss FROM z GROUP BY label
""")
def focal_loss(spark: SparkSession, d: str) -> DataFrame:
    """SCR-11: focal loss (gamma 2) of every vector from its squared distances to all class centroids, mean and sum per class."""
    emb = table(spark, d, "embeddings")
    head = SCR.fit_centroids(emb, "embedding", by=["label"]).orderBy("label").collect()  # classes x d numbers, literals below
    v = F.col("embedding").cast("array<double>")
    logits = emb.select("label", F.array(*[-A.squared_error_sum(v, F.lit(c.centroid)) for c in head]).alias("logits"),
                        (F.array_position(F.array(*[F.lit(c.label) for c in head]), F.col("label")) - 1).alias("target"))
    fl = SCR.focal_loss(logits, "logits", "target", gamma=2.0)
    return fl.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), r(F.avg("focal_loss")).alias("mean_loss"),
                                   r(F.sum("focal_loss"), 4).alias("sum_loss"))


@register("reconstruction_loss", f"""
WITH {_EMB_SQL},
c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i),
j AS (SELECT e.vec_id, e.x, c.m FROM e JOIN c USING (label, i)),
v AS (SELECT vec_id, sum((m - x) * (m - x)) AS se, count(*) AS dd, sum(m * x) AS dot,
             sqrt(sum(m * m)) AS nm, sqrt(sum(x * x)) AS nx FROM j GROUP BY vec_id),
a AS (SELECT sum(se) / sum(dd) AS mse, avg(dot / (greatest(nm, 1e-8) * greatest(nx, 1e-8))) AS mean_cosine FROM v)
SELECT round(mse, 8) AS mse, round(mean_cosine, 6) AS mean_cosine, round(mse + 0.05 * (1 - mean_cosine), 6) AS loss FROM a
""")
def reconstruction_loss(spark: SparkSession, d: str) -> DataFrame:
    """SCR-12: global MSE + 0.05 x (1 - mean cosine) against the class-centroid reconstruction."""
    emb = table(spark, d, "embeddings")
    cent = SCR.fit_centroids(emb, "embedding", by=["label"])
    j = emb.join(F.broadcast(cent), "label")
    out = SCR.reconstruction_loss(j, "centroid", "embedding", 0.05)
    return out.select(r("mse", 8).alias("mse"), r("mean_cosine").alias("mean_cosine"), r("loss").alias("loss"))


@register("event_alerts", f"""
WITH {EVENTS_TAXONOMY_SQL},
rec AS (SELECT e.event_id, e.user_id, e.event_type, coalesce(tax.category, 'Other') AS category,
               coalesce(tax.severity, 'medium') AS severity
        FROM events e LEFT JOIN tax ON trim(e.event_type) = tax.raw_label AND tax.dataset = 'events'),
al AS (SELECT event_id AS traffic_record_id, severity, 'Detected ' || coalesce(event_type, 'unknown') || ' from unknown' AS message
       FROM rec WHERE category IN ('DoS', 'Probe', 'R2L', 'U2R'))
SELECT al.severity, al.message, count(*) AS alerts, count(DISTINCT rec.user_id) AS users
FROM al JOIN rec ON al.traffic_record_id = rec.event_id GROUP BY 1, 2
""")
def event_alerts(spark: SparkSession, d: str) -> DataFrame:
    """SCR-10 / SRV-04 / JOIN-05: alert rows for attack categories (taxonomy severity), joined back to records."""
    rec = TAX.map_labels(table(spark, d, "events"), "event_type", "events", TAX.taxonomy(spark, EVENTS_TAXONOMY))
    al = SCR.alerts_from_records(rec, "event_id", "event_type")
    j = al.join(rec.select("event_id", "user_id"), al.traffic_record_id == F.col("event_id"))
    return j.groupBy("severity", "message").agg(F.count(F.lit(1)).alias("alerts"), F.count_distinct("user_id").alias("users"))


@register("payload_contract", """
WITH p AS (SELECT CASE WHEN json_type(props) <> 'OBJECT' THEN 'payload is not a JSON object'
                       WHEN json_extract_string(props, '$.k') IS NULL THEN 'missing features: k'
                       WHEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NULL THEN 'non-numeric or non-finite value: k'
                  END AS payload_error, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
SELECT payload_error, count(*) AS rows, round(sum(k), 2) AS k_sum FROM p GROUP BY 1
""")
def payload_contract(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-14 / PRJ-15: JSON payload -> map -> contract checks -> numeric feature."""
    p = SH.payload_to_features(table(spark, d, "events"), "props", ["k"])
    return p.groupBy("payload_error").agg(F.count(F.lit(1)).alias("rows"), r(F.sum("k"), 2).alias("k_sum"))


@register("secure_scoring", """
WITH st AS (SELECT avg(l_discount) AS md, stddev_samp(l_discount) AS sd, avg(l_extendedprice) AS mp, stddev_samp(l_extendedprice) AS sp FROM lineitem),
z AS (SELECT (l_discount - md) / sd AS zd, (l_extendedprice - mp) / sp AS zp FROM lineitem, st),
s AS (SELECT least(greatest(zd, -5.0), 5.0) AS zd, least(greatest(zp, -5.0), 5.0) AS zp FROM z),
m AS (SELECT CASE WHEN zd < 1.0 THEN 'BENIGN' ELSE 'DDoS' END AS pred, round(least(abs(zd) / 3.0, 1.0), 4) AS conf,
             round(tanh(abs(zp) / 3.0), 4) AS anom FROM s),
t AS (SELECT *, upper(pred) IN ('BENIGN', 'BENIGN_FINAL', 'NORMAL') AS benign FROM m)
SELECT CASE WHEN benign AND anom >= 0.7 THEN 'ZERO_DAY_SUSPECT' WHEN NOT benign AND conf >= 0.85 THEN CASE WHEN anom >= 0.5 THEN 'CRITICAL' ELSE 'HIGH' END
            WHEN NOT benign THEN 'MEDIUM' ELSE 'LOW' END AS severity, count(*) AS rows
FROM t GROUP BY 1
""")
def secure_scoring(spark: SparkSession, d: str) -> DataFrame:
    """SCR-08 / SCR-09 / FLT-12: standardize -> sanitize to [-5, 5] -> model -> triage."""
    li = table(spark, d, "lineitem")
    feats = ["l_discount", "l_extendedprice"]
    z = FIT.apply_scaler(li, FIT.fit_scaler(li, feats, "standard"), keep=[])

    def model(df: DataFrame) -> DataFrame:
        return df.select(F.when(F.col("l_discount") < 1.0, "BENIGN").otherwise("DDoS").alias("prediction_label"),
                         F.round(F.least(F.abs("l_discount") / 3.0, F.lit(1.0)), 4).alias("confidence"),
                         F.round(F.tanh(F.abs("l_extendedprice") / 3.0), 4).alias("anomaly_score"))
    t = SCR.score_secure(z, feats, model, lo=-5.0, hi=5.0)
    return t.groupBy("severity").agg(F.count(F.lit(1)).alias("rows"))


__all__ = ["FEATS", "TAX"]
