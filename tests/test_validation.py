"""Validation, cleaning and split on the planted flow fixtures (reference known answers)."""
from __future__ import annotations

import pytest

import numpy as np
from pyspark.sql import functions as F

from flowlens import config as C
from flowlens.operators import quality as VAL
from flowlens.operators import split as SPL
from flowlens.plans import prepare as PREP

from .conftest import dirty_frame, enterprise_frame, iot_frame, to_spark


def _report(spark, pdf, cfg):
    df = to_spark(spark, pdf)
    f = VAL.validate(df, cfg)
    rows = f.collect()
    s = VAL.summarize(f, df, cfg).first()
    return rows, s


def test_clean_enterprise_is_valid(spark):
    rows, s = _report(spark, enterprise_frame(), C.ENTERPRISE)
    assert s["is_valid"] and s["error_count"] == 0 and s["duplicate_record_count"] == 0
    assert s["total_records"] == 100


def test_clean_iot_is_valid(spark):
    _, s = _report(spark, iot_frame(), C.IOT)
    assert s["is_valid"]


def test_dirty_findings(spark):
    rows, s = _report(spark, dirty_frame(), C.ENTERPRISE)
    by = {(r["check"], r["column"]): r for r in rows}
    assert by[("infinite_values", "Flow Bytes/s")]["count"] == 1
    assert by[("infinite_values", "Flow Packets/s")]["count"] == 1
    assert by[("duplicate_rows", None)]["count"] == 5
    assert by[("negative_values", "Flow Duration")]["count"] == 1
    assert ("zero_variance", "Fwd PSH Flags") in by
    leaks = {c for (k, c) in by if k == "leakage_column"}
    assert leaks == {"Source IP", "Destination IP", "Source Port", "Timestamp"}
    assert not s["is_valid"]
    # -inf counts as negative, so Flow Packets/s also violates its constraint
    assert by[("negative_values", "Flow Packets/s")]["count"] == 1


def test_missing_columns_and_label(spark):
    pdf = enterprise_frame().drop(columns=["Flow Duration", "Total Fwd Packets"])
    rows, s = _report(spark, pdf, C.ENTERPRISE)
    assert not s["is_valid"]
    assert {r["column"] for r in rows if r["check"] == "missing_feature"} == {"Flow Duration", "Total Fwd Packets"}
    rows, s = _report(spark, enterprise_frame().drop(columns=["Label"]), C.ENTERPRISE)
    assert not s["is_valid"] and any(r["check"] == "missing_label" for r in rows)


def test_missing_ratio_limit(spark):
    pdf = enterprise_frame()
    pdf.loc[:20, "Flow Duration"] = np.nan          # 21 of 100 rows
    rows, s = _report(spark, pdf, C.ENTERPRISE)
    r = [x for x in rows if x["check"] == "missing_values" and x["column"] == "Flow Duration"][0]
    assert r["severity"] == "error" and r["count"] == 21 and not s["is_valid"]


def test_unknown_label_is_warning_only(spark):
    pdf = enterprise_frame()
    pdf.loc[0, "Label"] = "Ransomware_WannaCry_Unknown"
    rows, s = _report(spark, pdf, C.ENTERPRISE)
    assert s["is_valid"]
    assert [r["column"] for r in rows if r["check"] == "invalid_label"] == ["Ransomware_WannaCry_Unknown"]


def test_empty_frame_is_invalid(spark):
    df = to_spark(spark, enterprise_frame()).limit(0)
    s = VAL.summarize(VAL.validate(df, C.ENTERPRISE), df, C.ENTERPRISE).first()
    assert not s["is_valid"]


def test_split_floors_per_class(spark):
    pdf = enterprise_frame()
    pdf["row_id"] = range(len(pdf))
    s = SPL.stratified_split(to_spark(spark, pdf), "Label", ["row_id"])
    got = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert got == {"train": 69, "val": 14, "test": 17}
    pdf = iot_frame()
    pdf["row_id"] = range(len(pdf))
    s = SPL.stratified_split(to_spark(spark, pdf), "label", ["row_id"])
    got = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert got == {"train": 69, "val": 13, "test": 18}


def test_split_ratio_check(spark):
    with pytest.raises(ValueError):
        SPL.stratified_split(to_spark(spark, enterprise_frame()), "Label", ["Label"], 0.6, 0.2, 0.3)


def test_prepare_pipeline_minmax_bounds_and_cleaning(spark):
    pdf = dirty_frame()
    pdf["row_id"] = list(range(100)) + list(range(20, 25))      # duplicates share their key
    df = to_spark(spark, pdf)
    with pytest.raises(ValueError, match="do not pass validation"):
        PREP.fit_transform(df, C.ENTERPRISE, ["row_id"], "minmax", "median")
    p = PREP.fit_transform(df, C.ENTERPRISE, ["row_id"], "minmax", "median", strict=False)
    out = p.data
    assert "Fwd PSH Flags" in p.dropped_constant
    mins = out.agg(*[F.min(F.col(f"`{f}`")).alias(f"a{i}") for i, f in enumerate(p.features)]).first()
    maxs = out.agg(*[F.max(F.col(f"`{f}`")).alias(f"a{i}") for i, f in enumerate(p.features)]).first()
    assert min(mins) >= 0.0 and max(maxs) <= 1.0
    # identity columns never reach the output; duplicates collapse within their split
    assert not ({"Source IP", "Timestamp"} & set(out.columns))
    assert out.count() == 100
    assert {r["y_binary"] for r in out.select("y_binary").distinct().collect()} == {0, 1}
