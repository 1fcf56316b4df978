"""Classifier evaluation over a scored table (EVAL-*).

Input: any DataFrame with a truth column and a prediction column (optionally a
probability array). Everything reduces to the confusion counts
``groupBy(truth, pred).count()`` - a class-sized table - so metrics cost one
shuffle of at most K^2 rows after map-side combine. No row order is assumed:
truth and prediction travel in the same row (JOIN-04 joins on a key, never on position).
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from .ranking import mann_whitney_auc, prefix_sums


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """EVAL-01: observed (truth, prediction, count) cells; ``confusion_grid`` adds the zero cells."""
    return df.groupBy(col(truth).cast("string").alias("truth"), col(pred).cast("string").alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("count"))


def confusion_grid(cm: DataFrame) -> DataFrame:
    """EVAL-01: every (truth, prediction) pair over labels U predictions, zero cells included.

    The grid is (labels x labels) cells, which is the matrix itself."""
    labels = cm.select(F.col("truth").alias("label")).union(cm.select("prediction")).where(F.col("label").isNotNull()).distinct()
    cells = labels.select(F.col("label").alias("truth")).crossJoin(labels.select(F.col("label").alias("prediction")))
    return cells.join(cm, ["truth", "prediction"], "left").na.fill(0, ["count"])


def per_class(cm: DataFrame, digits: int | None = 4) -> DataFrame:
    """EVAL-06: precision / recall / F1 / support per class over labels U predictions (zero division -> 0)."""
    tp = cm.where(F.col("truth") == F.col("prediction")).select(F.col("truth").alias("cls"), F.col("count").alias("tp"))
    sup = cm.groupBy(F.col("truth").alias("cls")).agg(F.sum("count").alias("support"))
    prd = cm.groupBy(F.col("prediction").alias("cls")).agg(F.sum("count").alias("predicted"))
    j = sup.join(prd, "cls", "full").join(tp, "cls", "left").na.fill(0, ["tp", "support", "predicted"])
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    out = j.select("cls", "tp", "support", "predicted", p.alias("precision"), r.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    out = out.withColumn("f1", f1)
    if digits is not None:
        out = out.select("cls", "tp", "support", "predicted", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")])
    return out


def summary(cm: DataFrame) -> DataFrame:
    """EVAL-02 + EVAL-03: accuracy, balanced accuracy, macro and weighted P/R/F1 (one row)."""
    pc = per_class(cm, digits=None)
    return pc.agg(
        F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"), F.avg("f1").alias("f1_macro"),
        F.try_divide(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("precision_weighted"),
        F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("recall_weighted"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
        F.sum("support").alias("total_samples"))


def error_rates(cm: DataFrame, negative: str) -> DataFrame:
    """EVAL-04: FPR / FNR with ``negative`` (the benign class) as class 0.

    ``fpr_reference`` = attacks predicted as the benign class over all attacks (the
    compatible multiclass form); ``fpr`` = benign flows flagged as any attack over
    all benign flows (the true false-positive rate); ``fnr`` = attacks predicted
    benign over attacks. For two classes the compatible form equals the binary one
    with the positive class = the other label.
    """
    t_neg = F.col("truth") == negative
    p_neg = F.col("prediction") == negative
    a = cm.agg(
        F.sum(F.when(t_neg & p_neg, F.col("count")).otherwise(0)).alias("c00"),
        F.sum(F.when(t_neg, F.col("count")).otherwise(0)).alias("row0"),
        F.sum(F.when(p_neg, F.col("count")).otherwise(0)).alias("col0"),
        F.sum("count").alias("n"))
    fp_ref = F.col("col0") - F.col("c00")
    tn_ref = F.col("n") - F.col("row0") - F.col("col0") + F.col("c00")
    fn_ref = F.col("row0") - F.col("c00")
    return a.select(
        F.coalesce(F.try_divide(fp_ref.cast("double"), fp_ref + tn_ref), F.lit(0.0)).alias("fpr_reference"),
        F.coalesce(F.try_divide(fn_ref.cast("double"), fn_ref + F.col("c00")), F.lit(0.0)).alias("fnr_reference"),
        F.coalesce(F.try_divide(fn_ref.cast("double"), F.col("row0")), F.lit(0.0)).alias("fpr"),
        F.coalesce(F.try_divide(fp_ref.cast("double"), F.col("n") - F.col("row0")), F.lit(0.0)).alias("fnr"))


def binary_auc(df: DataFrame, truth: str, score: str, positive=1) -> DataFrame:
    """EVAL-05 (binary): ROC-AUC of a score against truth == positive (rank-sum, ties averaged)."""
    long = df.select(F.lit("score").alias("feature"), col(score).cast("double").alias("value"),
                     (col(truth) == F.lit(positive)).cast("int").alias("__pos")).where(F.col("value").isNotNull())
    a = mann_whitney_auc(long, "__pos")
    return a.where(F.col("__pos") == 1).select("auc")


def ovr_macro_auc(df: DataFrame, truth_idx: str, prob: str) -> DataFrame:
    """EVAL-05 (multiclass): one-vs-rest macro ROC-AUC from a probability array column."""
    long = df.select(F.posexplode(col(prob)).alias("cls", "value"), col(truth_idx).alias("__t"))
    long = long.select(F.col("cls").cast("string").alias("feature"), F.col("value").cast("double").alias("value"),
                       (F.col("__t") == F.col("cls")).cast("int").alias("__pos"))
    a = mann_whitney_auc(long, "__pos").where(F.col("__pos") == 1)
    return a.agg(F.avg("auc").alias("roc_auc_ovr_macro"), F.count("auc").alias("classes"))


def average_precision(df: DataFrame, truth: str, score: str, positive=1) -> DataFrame:
    """EVAL-12: area under the precision-recall curve (step-wise average precision).

    AP = sum over distinct scores s (descending) of pos(s)/P * precision(>= s);
    cumulative counts come from the distributed prefix scan. Rows without a score or a truth do not count.
    """
    d = df.select(col(score).cast("double").alias("s"), (col(truth) == F.lit(positive)).cast("long").alias("y"))
    d = d.where(F.col("s").isNotNull() & ~F.isnan("s") & F.col("y").isNotNull())
    v = d.groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    v = v.withColumn("__neg_s", -F.col("s"))
    pre = prefix_sums(v, [], "__neg_s", ["pos", "neg"])  # sums over higher scores
    tp = F.col("pos_below") + F.col("pos")
    fp = F.col("neg_below") + F.col("neg")
    # sum of pos over all scores is P, so one aggregate gives the average
    return pre.agg(F.try_divide(F.sum(F.col("pos") * tp / (tp + fp)), F.sum("pos")).alias("average_precision"))


def classification_report(cm: DataFrame, digits: int = 4) -> DataFrame:
    """EVAL-07: per-class rows + accuracy, macro avg, weighted avg rows."""
    pc = per_class(cm, digits=None)
    rows = pc.select(F.col("cls").alias("row"), "precision", "recall", "f1", "support")
    s = summary(cm)
    tail = s.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("accuracy").alias("f1"),
                 F.col("total_samples").alias("support")),
        F.struct(F.lit("macro avg").alias("row"), F.col("precision_macro").alias("precision"),
                 F.col("recall_macro").alias("recall"), F.col("f1_macro").alias("f1"), F.col("total_samples").alias("support")),
        F.struct(F.lit("weighted avg").alias("row"), F.col("precision_weighted").alias("precision"),
                 F.col("recall_weighted").alias("recall"), F.col("f1_weighted").alias("f1"),
                 F.col("total_samples").alias("support")))).alias("r")).select("r.*")
    out = rows.unionByName(tail)
    return out.select("row", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")], "support")


def compare_models(metrics: DataFrame) -> DataFrame:
    """EVAL-08: formatted comparison table from per-model metric rows
    (model, accuracy, f1_macro, precision_macro, recall_macro, fpr, roc_auc, p95_ms, rows_per_sec)."""
    pct = lambda c: F.concat(F.format_string("%.2f", F.col(c) * 100), F.lit("%"))
    return metrics.select(
        F.col("model").alias("Model"), pct("accuracy").alias("Accuracy"), pct("f1_macro").alias("F1-Macro"),
        pct("precision_macro").alias("Precision"), pct("recall_macro").alias("Recall"), pct("fpr").alias("FPR"),
        F.when(F.col("roc_auc").isNotNull() & (F.col("roc_auc") != 0), F.format_string("%.4f", "roc_auc"))
        .otherwise("N/A").alias("ROC-AUC"),
        F.when(F.col("p95_ms").isNotNull(), F.concat(F.format_string("%.2f", "p95_ms"), F.lit(" ms")))
        .otherwise("N/A").alias("p95 Latency"),
        F.when(F.col("rows_per_sec").isNotNull(), F.concat(F.format_string("%.0f", "rows_per_sec"), F.lit(" flows/s")))
        .otherwise("N/A").alias("Throughput"))


def missed_as_normal(df: DataFrame, truth: str, pred: str, benign: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """EVAL-09: share of attack rows predicted benign (per model / group)."""
    b = [x for x in benign]
    is_att = ~col(truth).isin(b)
    return df.groupBy(*[col(x) for x in by]).agg(
        F.sum(is_att.cast("int")).alias("attacks"),
        F.sum((is_att & col(pred).isin(b)).cast("int")).alias("missed"),
    ).withColumn("missed_as_normal_rate", F.try_divide(F.col("missed").cast("double"), F.col("attacks")))


def dangerous_misses(df: DataFrame, truth: str, pred: str, benign: Sequence[str]) -> DataFrame:
    """EVAL-10: per attack class: total, missed (predicted benign), miss rate %."""
    b = list(benign)
    att = df.where(~col(truth).isin(b))
    return att.groupBy(col(truth).alias("attack_class")).agg(
        F.count(F.lit(1)).alias("total"), F.sum(col(pred).isin(b).cast("int")).alias("missed")
    ).withColumn("miss_rate_pct", F.round(100.0 * F.col("missed") / F.col("total"), 2))


def worst_class(misses: DataFrame) -> DataFrame:
    """EVAL-10: the attack class with the highest miss rate (ties: larger total, then name)."""
    return misses.agg(F.max_by("attack_class", F.struct("miss_rate_pct", "total", F.col("attack_class"))).alias("worst_class"),
                      F.max("miss_rate_pct").alias("worst_miss_rate_pct"))


def zero_day_detection(zd: DataFrame, pred: str, benign: Sequence[str]) -> DataFrame:
    """EVAL-11: total, flagged (predicted non-benign), missed, detection rate %."""
    b = list(benign)
    return zd.agg(F.count(F.lit(1)).alias("total"), F.sum((~col(pred).isin(b)).cast("int")).alias("flagged")) \
        .withColumn("missed", F.col("total") - F.col("flagged")) \
        .withColumn("detection_rate_pct", F.round(F.try_divide(100.0 * F.col("flagged"), F.col("total")), 2))


def split_metrics(df: DataFrame, split: str, truth: str, pred: str, loss: str | None = None) -> DataFrame:
    """EVAL-13: accuracy (and mean loss) per split."""
    aggs = [F.avg((col(truth) == col(pred)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("rows")]
    if loss:
        aggs.append(F.avg(col(loss)).alias("mean_loss"))
    return df.groupBy(col(split)).agg(*aggs)
