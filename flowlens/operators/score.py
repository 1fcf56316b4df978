"""Scoring, anomaly detection and triage (SCR-*).

Everything is a column expression over a scored table (array built-ins, CASE
WHEN), so scoring stays inside whole-stage codegen. Model-specific parts take an
MLlib ``Transformer`` or any ``DataFrame -> DataFrame`` callable.
"""
from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import arrays as A
from ..functions.columns import col, finite
from .ranking import long_values, select_quantiles


def prediction_confidence(df: DataFrame, prob: str, classes: Sequence[str] | None = None,
                          pred_out: str = "prediction_label", conf_out: str = "confidence", digits: int = 4) -> DataFrame:
    """SCR-01: argmax class (decoded, fallback Class_i) and max probability."""
    p = col(prob)
    if dict(df.dtypes).get(prob, "").startswith("vector") or dict(df.dtypes).get(prob) == "vector":
        from pyspark.ml.functions import vector_to_array
        p = vector_to_array(col(prob))
    df = df.withColumn("__p", p)
    idx = A.argmax(F.col("__p"))
    names = F.array(*[F.lit(c) for c in classes]) if classes else None
    name = (F.coalesce(F.element_at(names, idx + 1), F.concat(F.lit("Class_"), idx.cast("string")))
            if names is not None else F.concat(F.lit("Class_"), idx.cast("string")))
    return df.withColumn(pred_out, name).withColumn(conf_out, F.round(F.array_max("__p"), digits)).drop("__p")


def features_array(features: Sequence[str]) -> Column:
    return F.array(*[col(f).cast("double") for f in features])


def fit_centroids(df: DataFrame, vec: str, by: Sequence[str] = ()) -> DataFrame:
    """SCR-02 / SCR-04 fit: mean vector per group (the linear reconstructor).

    posexplode -> groupBy(group, position) -> avg: the state is (#groups x d).
    """
    ex = df.select(*[col(b) for b in by], F.posexplode(col(vec)).alias("__i", "__v"))
    m = ex.groupBy(*[col(b) for b in by], "__i").agg(F.avg("__v").alias("__m"))
    return m.groupBy(*[col(b) for b in by]).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias("centroid"))


def reconstruction_error(df: DataFrame, vec: str, centroids: DataFrame, by: Sequence[str] = (),
                         out: str = "recon_error") -> DataFrame:
    """SCR-02: per-row MSE between the vector and its reconstruction (centroid).

    The centroid table is (#groups x d) numbers; Spark's own size threshold picks the join.
    """
    if by:
        j = df.join(centroids, list(by), "left")
    else:
        c = centroids.first()["centroid"]          # one vector of d numbers (dimension-bounded)
        j = df.withColumn("centroid", F.array(*[F.lit(float(x)) for x in c]))
    return j.withColumn(out, A.mse(col(vec).cast("array<double>"), F.col("centroid"))).drop("centroid")


def anomaly_score(err: Column, threshold: float) -> Column:
    """SCR-03: tanh(mse / max(threshold, 1e-6))."""
    return F.tanh(err / F.lit(max(float(threshold), 1e-6)))


def calibrate_threshold(df: DataFrame, err: str, p: float = 0.99) -> float:
    """SCR-04 / AGG-08: exact p-th percentile of the error on (benign) rows -> scalar."""
    got = select_quantiles(df.select(finite(col(err)).alias("err")), ["err"], [p])
    return float(got[0][2]) if got else 0.0


def hybrid_label(pred: Column, score: Column, threshold: float = 0.70) -> Column:
    """SCR-05: benign prediction with anomaly score >= threshold -> Suspected_Anomaly."""
    benign = F.upper(pred).isin(list(C.TRIAGE_BENIGN))
    return F.when(benign & (score >= threshold), F.lit(C.SUSPECTED_ANOMALY)).otherwise(pred)


def entropy(prob: Column, digits: int = 4) -> Column:
    """SCR-06."""
    return A.normalized_entropy(prob, digits)


def triage(df: DataFrame, pred: str, conf: str, score: str, prob: str | None = None,
           anomaly_threshold: float = 0.70, confidence_threshold: float = 0.85) -> DataFrame:
    """SCR-07: severity, action, final label, is_alert from the *raw* prediction.

    A row that cannot be judged (no prediction, or no number as confidence or score) is
    quarantined with severity UNSCORABLE, never allowed."""
    benign = F.upper(col(pred)).isin(list(C.TRIAGE_BENIGN))
    anomalous = col(score) >= anomaly_threshold
    high = col(conf) >= confidence_threshold
    number = lambda c: col(c).isNotNull() & ~F.isnan(col(c).cast("double"))
    unscorable = ~(col(pred).isNotNull() & number(conf) & number(score))
    sev = (F.when(unscorable, "UNSCORABLE").when(benign & anomalous, "ZERO_DAY_SUSPECT")
           .when(~benign & high, F.when(col(score) >= 0.50, "CRITICAL").otherwise("HIGH"))
           .when(~benign, "MEDIUM").otherwise("LOW"))
    act = (F.when(unscorable | (benign & anomalous), "QUARANTINE_FOR_ANALYSIS").when(~benign & high, "BLOCK_IMMEDIATE")
           .when(~benign, "INSPECT_PACKET_TRACE").otherwise("ALLOW"))
    final = F.when(unscorable, F.coalesce(col(pred), F.lit("UNSCORABLE"))).when(benign & anomalous, F.lit(C.SUSPECTED_ZERO_DAY)).otherwise(col(pred))
    out = (df.withColumn("severity", sev).withColumn("action", act).withColumn("classification", final)
           .withColumn("raw_prediction", col(pred))
           .withColumn("confidence_r", F.round(col(conf).cast("double"), 4))
           .withColumn("anomaly_score_r", F.round(col(score).cast("double"), 4))
           .withColumn("entropy", entropy(col(prob)) if prob else F.lit(0.0))
           .withColumn("is_alert", F.col("severity").isin(list(C.ALERT_SEVERITIES)) | unscorable))
    return out


def score_secure(df: DataFrame, features: Sequence[str], model: Callable[[DataFrame], DataFrame],
                 keep: Sequence[str] = (), lo: float = -10.0, hi: float = 10.0, **triage_kw) -> DataFrame:
    """SCR-08: sanitize -> model (prediction_label, confidence, anomaly_score) -> triage."""
    from .shape import sanitize
    clean = sanitize(df, features, lo, hi, keep=list(keep))
    scored = model(clean)
    return triage(scored, "prediction_label", "confidence", "anomaly_score", **triage_kw)


def alerts_from_records(records: DataFrame, id_col: str, label: str, category: str = "category",
                        severity: str = "severity", ts: str | None = None) -> DataFrame:
    """SCR-10: one alert row per attack record, severity from the taxonomy and a message
    with an 'unknown' fallback for missing addresses."""
    from .shape import attack_category_expr
    src = F.coalesce(col("source_ip").cast("string"), F.lit("unknown")) if "source_ip" in records.columns else F.lit("unknown")
    msg = F.concat(F.lit("Detected "), F.coalesce(col(label).cast("string"), F.lit("unknown")), F.lit(" from "), src)
    out = records.where(attack_category_expr(category)).select(
        col(id_col).alias("traffic_record_id"), col(severity).alias("severity"), msg.alias("message"),
        *([col(ts).alias("created_at")] if ts else []))
    return out


def focal_loss(df: DataFrame, logits: str, target: str, gamma: float = 2.0, alpha: Sequence[float] | None = None,
               out: str = "focal_loss") -> DataFrame:
    """SCR-11: per-row focal loss -alpha_t (1 - p_t)^gamma ln p_t from logits (log-softmax)."""
    # each step its own column so the logits are not re-evaluated inside the lambda
    d = df.withColumn("__lg", col(logits).cast("array<double>")).withColumn("__mx", F.array_max("__lg"))
    d = d.withColumn("__lse", F.col("__mx") + F.log(A.array_sum(F.transform("__lg", lambda x: F.exp(x - F.col("__mx"))))))
    d = d.withColumn("__lpt", F.element_at("__lg", col(target).cast("int") + 1) - F.col("__lse"))
    loss = -F.pow(1.0 - F.exp("__lpt"), F.lit(gamma)) * F.col("__lpt")
    if alpha is not None:
        loss = loss * F.element_at(F.array(*[F.lit(float(a)) for a in alpha]), col(target).cast("int") + 1)
    return d.withColumn(out, loss).drop("__lg", "__mx", "__lse", "__lpt")


def focal_loss_reduce(df: DataFrame, loss: str = "focal_loss") -> DataFrame:
    """SCR-11: mean and sum."""
    return df.agg(F.avg(col(loss)).alias("mean_loss"), F.sum(col(loss)).alias("sum_loss"))


def reconstruction_loss(df: DataFrame, recon: str, orig: str, cosine_weight: float = 0.05) -> DataFrame:
    """SCR-12: global MSE over all elements + w x (1 - mean row cosine)."""
    r = col(recon).cast("array<double>")
    o = col(orig).cast("array<double>")
    per = df.select(A.squared_error_sum(r, o).alias("__se"), F.size(o).alias("__d"), A.cosine(r, o).alias("__cos"))
    agg = per.agg((F.sum("__se") / F.sum("__d")).alias("mse"), F.avg("__cos").alias("mean_cosine"))
    loss = F.col("mse") + (cosine_weight * (1 - F.col("mean_cosine")) if cosine_weight > 0 else F.lit(0.0))
    return agg.withColumn("loss", loss)


def long_errors(df: DataFrame, err: str):
    return long_values(df, [err])


def score_payloads(df: DataFrame, payload_col: str, features: Sequence[str], center: Sequence[float],
                   scale: Sequence[float], model: Callable[[DataFrame], DataFrame], model_version: str,
                   keep: Sequence[str] = (), benign: Sequence[str] = C.TRIAGE_BENIGN) -> tuple[DataFrame, DataFrame]:
    """SCR-09: JSON payload -> contract checks -> stored scaling -> model -> result rows.

    Returns (results, quarantine): rows failing the payload contract go to the
    quarantine frame with their error; the rest are scaled with the stored contract
    (scale 0 -> 1), scored, and get is_alert and the model version.
    """
    from .fit import apply_stored_scaler
    from .shape import payload_to_features
    p = payload_to_features(df, payload_col, features, keep=list(keep))
    bad = p.where(F.col("payload_error").isNotNull())
    good = p.where(F.col("payload_error").isNull())
    scaled = apply_stored_scaler(good, center, scale, features, keep=list(keep))
    scored = model(scaled)
    res = scored.withColumn("is_alert", ~F.upper(F.col("prediction_label")).isin([b.upper() for b in benign])) \
        .withColumn("model_version", F.lit(model_version))
    return res, bad
