"""Planted feature-quality issues, taxonomy mapping, scoring and triage known answers."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens import config as C
from flowlens.operators import evaluate as EV
from flowlens.operators import features as FS
from flowlens.operators import labels as TAX
from flowlens.operators import quality as VAL
from flowlens.operators import score as SCR
from flowlens.operators import shape as SH
from flowlens.operators import stats as AGG


def planted(spark, seed=0, n=300):
    """constant, near-duplicate, identity-like and leaking columns."""
    rng = np.random.default_rng(seed)
    labels = rng.choice(["Normal", "DoS", "Probe", "R2L"], n)
    code = pd.Series(labels).map({"Normal": 0, "DoS": 1, "Probe": 2, "R2L": 3}).to_numpy()
    fd = rng.exponential(100.0, n)
    pdf = pd.DataFrame({"flow_duration": fd, "fwd_packets": rng.poisson(5, n).astype(float),
                        "flow_duration_dup": fd * 1.0001, "constant_col": 1.0,
                        "leak_col": code * 10 + rng.normal(0, 0.1, n),
                        "Destination Port": rng.integers(1, 65535, n).astype(float), "label": labels})
    return spark.createDataFrame(pdf)


def test_planted_issues_flagged(spark):
    df = planted(spark)
    feats = ["flow_duration", "fwd_packets", "flow_duration_dup", "constant_col", "leak_col", "Destination Port"]
    nz = {r["feature"] for r in VAL.near_zero_variance(df, feats).collect() if r["near_zero"]}
    assert nz == {"constant_col"}
    red = AGG.redundant_pairs(AGG.correlation_pairs(df, feats), 0.95).collect()
    assert [(r["feature_a"], r["feature_b"]) for r in red] == [("flow_duration", "flow_duration_dup")]
    ident = {r["column"] for r in SH.identity_like_columns(feats, spark).collect() if r["identity_like"]}
    assert ident == {"Destination Port"}
    sep = {r["feature"]: r["flagged"] for r in FS.single_feature_separability(df, feats, "label").collect()}
    assert sep["leak_col"] is True and sep["flow_duration"] is False
    assert sep["constant_col"] is False        # all ties: AUC 0.5, never flagged


def test_control_columns_not_flagged(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(0, 1, 300), "b": rng.normal(5, 2, 300),
                        "label": rng.choice(["x", "y"], 300)})
    df = spark.createDataFrame(pdf)
    assert AGG.redundant_pairs(AGG.correlation_pairs(df, ["a", "b"]), 0.95).count() == 0
    assert not any(r["flagged"] for r in FS.single_feature_separability(df, ["a", "b"], "label").collect())


def test_anova_matches_formula(spark):
    df = planted(spark)
    got = {r["feature"]: r["f_score"] for r in FS.anova_f(df, ["leak_col", "fwd_packets"], "label").collect()}
    pdf = df.toPandas()
    for f in ["leak_col", "fwd_packets"]:
        groups = [g[f].to_numpy() for _, g in pdf.groupby("label")]
        allv = pdf[f].to_numpy()
        ssb = sum(len(g) * (g.mean() - allv.mean()) ** 2 for g in groups)
        ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
        k, n = len(groups), len(allv)
        assert got[f] == pytest.approx((ssb / (k - 1)) / (ssw / (n - k)), rel=1e-9)


def test_label_mapping_and_consolidation(spark):
    df = spark.createDataFrame([("BENIGN",), ("DDoS",), ("unknown",), (" PortScan ",)], "Label string")
    m = {r["Label"]: (r["category"], r["severity"]) for r in TAX.map_labels(df, "Label", "cicids2017").collect()}
    assert m["BENIGN"] == ("Normal", "none") and m["DDoS"] == ("DoS", "critical")
    assert m["unknown"] == ("Other", "medium") and m[" PortScan "] == ("Probe", "low")
    iot = spark.createDataFrame([("Mirai-udpplain",), ("DDoS-SYN_Flood",), ("Uploading_Attack",)], "label string")
    assert {r["category"] for r in TAX.map_labels(iot, "label", "ciciot2023").collect()} == {"U2R", "DoS", "R2L"}
    fam = {r["label"] for r in TAX.consolidate(iot, "label").collect()}
    assert fam == {"Mirai", "DDoS", "Uploading_Attack"}           # not in the family map: passes through
    gaps = [r["label"] for r in TAX.coverage_gaps(iot.union(spark.createDataFrame([("Zzz",)], "label string")),
                                                     "label", "ciciot2023").collect()]
    assert gaps == ["Zzz"]


def test_sanitizer_bounds(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"), float("-inf"), 100.0)], "a double, b double, c double, d double")
    r = SH.sanitize(df, ["a", "b", "c", "d"], -5.0, 5.0).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (0.0, 5.0, -5.0, 5.0)
    with pytest.raises(ValueError):
        SH.sanitize(df, ["a", "missing"], -5.0, 5.0)


def test_triage_cases(spark):
    df = spark.createDataFrame([("BENIGN", 0.95, 0.10), ("DDoS", 0.92, 0.80), ("BENIGN", 0.90, 0.88),
                                ("PortScan", 0.50, 0.20)], "p string, c double, a double")
    got = {(r["p"], r["a"]): (r["severity"], r["action"], r["classification"], r["is_alert"])
           for r in SCR.triage(df, "p", "c", "a").collect()}
    assert got[("BENIGN", 0.10)] == ("LOW", "ALLOW", "BENIGN", False)
    assert got[("DDoS", 0.80)] == ("CRITICAL", "BLOCK_IMMEDIATE", "DDoS", True)
    assert got[("BENIGN", 0.88)] == ("ZERO_DAY_SUSPECT", "QUARANTINE_FOR_ANALYSIS", "Suspected_Zero_Day", True)
    assert got[("PortScan", 0.20)] == ("MEDIUM", "INSPECT_PACKET_TRACE", "PortScan", True)


def test_entropy_and_hybrid(spark):
    df = spark.createDataFrame([([1 / 3, 1 / 3, 1 / 3], "BENIGN", 0.9), ([1.0, 0.0, 0.0], "normal", 0.1)],
                               "p array<double>, pred string, s double")
    rows = df.select(SCR.entropy(F.col("p")).alias("e"), SCR.hybrid_label(F.col("pred"), F.col("s")).alias("h")).collect()
    assert rows[0]["e"] == 1.0 and rows[0]["h"] == C.SUSPECTED_ANOMALY
    assert rows[1]["e"] == 0.0 and rows[1]["h"] == "normal"


def test_reconstruction_loss_and_scores(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ([0.5, 1.0, 1.5], [1.0, 2.0, 3.0])],
                               "r array<double>, o array<double>")
    same = SCR.reconstruction_loss(df.limit(1), "r", "o").first()
    assert same["loss"] == pytest.approx(0.0, abs=1e-12)
    both = SCR.reconstruction_loss(df, "r", "o").first()
    assert both["loss"] > same["loss"]
    s = df.select(SCR.anomaly_score(F.lit(0.5), 0.5).alias("s")).first()["s"]
    assert s == pytest.approx(math.tanh(1.0))


def test_focal_loss_reduces_to_ce(spark):
    df = spark.createDataFrame([([2.0, 0.0, -1.0], 0)], "logits array<double>, t int")
    r = SCR.focal_loss(df, "logits", "t", gamma=0.0).first()["focal_loss"]
    p = math.exp(2.0) / (math.exp(2.0) + 1 + math.exp(-1.0))
    assert r == pytest.approx(-math.log(p), rel=1e-12)


def test_metrics_known_answers(spark):
    rows = [("a", "a")] * 5 + [("a", "b")] * 1 + [("b", "b")] * 3 + [("b", "a")] * 1 + [("c", "a")] * 2
    cm = EV.confusion(spark.createDataFrame(rows, "t string, p string"), "t", "p")
    pc = {r["cls"]: r for r in EV.per_class(cm).collect()}
    assert pc["a"]["precision"] == round(5 / 8, 4) and pc["a"]["recall"] == round(5 / 6, 4)
    assert pc["c"]["precision"] == 0.0 and pc["c"]["f1"] == 0.0
    s = EV.summary(cm).first()
    assert s["accuracy"] == pytest.approx(8 / 12)
    assert s["balanced_accuracy"] == pytest.approx((5 / 6 + 3 / 4 + 0) / 3)
    e = EV.error_rates(cm, "a").first()
    assert e["fpr_reference"] == pytest.approx(3 / 6)       # attacks predicted as class 'a'
    assert e["fpr"] == pytest.approx(1 / 6)                 # benign 'a' flagged as attack


def test_average_precision_known(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, s double")
    ap = EV.average_precision(df, "y", "s", 1).first()["average_precision"]
    assert ap == pytest.approx(0.5 * 1.0 + 0.5 * (2 / 3))
