"""Ingest validation (type detection, sampling flag), CSV encoding fallback,
feature-quality report and payload scoring."""
from __future__ import annotations

import os

from pyspark.sql import functions as F

from flowlens import config as C
from flowlens.operators import quality as VAL
from flowlens.operators import score as SCR
from flowlens.sources import csv as CSV

from .conftest import enterprise_frame
from .test_features_scoring import planted


def test_detect_dataset_type():
    ent, iot = list(C.ENTERPRISE_FEATURES), list(C.IOT_FEATURES)
    assert VAL.detect_dataset_type(ent[:50]) == "CICIDS2017"
    assert VAL.detect_dataset_type(iot[:35]) == "CIC-IoT2023"
    assert VAL.detect_dataset_type(["a", "b", "c", "d", "e"]) is None
    assert VAL.detect_dataset_type(ent[:5] + ["x", "y"]) is None


def test_detect_types_many_files(spark):
    ent, iot = list(C.ENTERPRISE_FEATURES), list(C.IOT_FEATURES)
    rows = [("f1", c) for c in ent[:50]] + [("f2", c) for c in iot[:35]] + [("f3", c) for c in "abcde"]
    got = {r["file"]: r["dataset_type"] for r in
           VAL.detect_dataset_types(spark.createDataFrame(rows, "file string, column string")).collect()}
    assert got == {"f1": "CICIDS2017", "f2": "CIC-IoT2023", "f3": None}


def test_ingest_validation_sampled(spark, tmp_dir):
    pdf = enterprise_frame()
    path = os.path.join(tmp_dir, "flows.csv")
    import pandas as pd
    pd.concat([pdf] * 5, ignore_index=True).to_csv(path, index=False)
    summary, findings = VAL.ingest_validation(spark, path, max_rows=150)
    s = summary.first()
    assert s["dataset_type"] == "CICIDS2017" and s["sampled"] and s["rows_checked"] == 150 and s["total_rows"] == 500
    assert s["message"].startswith("Validated first 150 of 500 rows")
    summary, _ = VAL.ingest_validation(spark, path)
    assert not summary.first()["sampled"] and summary.first()["rows_checked"] == 500


def test_latin1_fallback(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/a", exist_ok=True)
    with open(f"{tmp_dir}/a/u.csv", "w", encoding="utf-8") as f:
        f.write("name,v\ncafé,1\n")
    with open(f"{tmp_dir}/a/l.csv", "w", encoding="latin-1") as f:
        f.write("name,v\nnaïve,2\n")
    got = {r["__source_file"]: r["name"] for r in CSV.read_all_csv(spark, tmp_dir).collect()}
    assert got == {"u.csv": "café", "l.csv": "naïve"}


def test_feature_quality_report(spark):
    df = planted(spark)
    feats = ["flow_duration", "fwd_packets", "flow_duration_dup", "constant_col", "leak_col", "Destination Port"]
    rep = VAL.feature_quality_report(df, feats, "label")
    recs = {r["feature"] for r in rep.where(F.col("section") == "recommendation").collect()}
    assert {"near_zero_variance", "redundant_pair", "identity_column", "single_feature_leak"} <= recs


def test_score_payloads(spark):
    df = spark.createDataFrame([('{"a": "2", "b": "4"}',), ('{"a": "1"}',)], "p string")

    def model(x):
        return x.withColumn("prediction_label", F.when(F.col("a") > 0, "DDoS").otherwise("BENIGN"))
    res, bad = SCR.score_payloads(df, "p", ["a", "b"], [1.0, 2.0], [1.0, 0.0], model, "v1", keep=["p"])
    r = res.first()
    assert (r["a"], r["b"], r["is_alert"], r["model_version"]) == (1.0, 2.0, True, "v1")
    assert bad.first()["payload_error"] == "missing features: b"
