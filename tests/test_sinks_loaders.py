"""Sinks (model persistence, append-only results, schema evolution, reports) and the
dataset loaders (enterprise / IoT folders, combined stack, per-file caps)."""
from __future__ import annotations

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens import config as C
from flowlens.operators.models import ModelSuite
from flowlens.sources import csv as CSV
from flowlens.sources import sinks as SNK

from .conftest import enterprise_frame, iot_frame


def _tiny(spark, n=240):
    return spark.createDataFrame([(float(i % 7), float((i * 3) % 5), ["a", "b", "c"][i % 3]) for i in range(n)],
                                 "f1 double, f2 double, label string")


def test_model_save_load_and_append(spark, tmp_dir):
    df = _tiny(spark)
    suite = ModelSuite(["decision_tree"]).fit(df, ["f1", "f2"], "label")
    SNK.save_model(suite.fitted["decision_tree"], f"{tmp_dir}/dt")
    again = SNK.load_model(f"{tmp_dir}/dt")
    a = suite.fitted["decision_tree"].transform(df).select("prediction").collect()
    b = again.transform(df).select("prediction").collect()
    assert a == b
    scored = suite.predict(df, "decision_tree").select(F.col("prediction").alias("classification"),
                                                       F.lit(0.9).alias("confidence"), F.lit(0.1).alias("anomaly_score"))
    SNK.append_predictions(scored, f"{tmp_dir}/pred", "v1")
    SNK.append_predictions(scored, f"{tmp_dir}/pred", "v1")
    p = spark.read.parquet(f"{tmp_dir}/pred")
    assert p.count() == 2 * df.count() and p.select("id").distinct().count() == p.count()
    assert set(p.columns) == {f.name for f in SNK.PREDICTIONS_SCHEMA.fields}


def test_schema_evolution_and_reports(spark, tmp_dir):
    spark.createDataFrame([("d1", "processed")], "dataset_id string, status string").write.parquet(f"{tmp_dir}/t/a")
    spark.createDataFrame([("d2", "failed", "boom")], "dataset_id string, status string, message string") \
        .write.parquet(f"{tmp_dir}/t/b")
    req = T.StructType([T.StructField("dataset_id", T.StringType()), T.StructField("status", T.StringType()),
                        T.StructField("message", T.StringType()), T.StructField("rows", T.LongType())])
    df = SNK.evolve_schema(spark, f"{tmp_dir}/t/*", req)
    assert set(df.columns) == {"dataset_id", "status", "message", "rows"}
    assert df.where(F.col("rows").isNull()).count() == 2
    SNK.write_report(df, f"{tmp_dir}/report", "json")
    assert spark.read.json(f"{tmp_dir}/report").count() == 2
    split = df.withColumn("split", F.when(F.col("dataset_id") == "d1", "train").otherwise("test"))
    SNK.write_splits(split, f"{tmp_dir}/splits")
    assert {"split=test", "split=train"} <= set(os.listdir(f"{tmp_dir}/splits"))


def test_dataset_loaders_and_combined(spark, tmp_dir):
    ent = enterprise_frame()
    ent.columns = [" " + c for c in ent.columns]                    # stray header spaces
    os.makedirs(f"{tmp_dir}/ent", exist_ok=True)
    ent.iloc[:50].to_csv(f"{tmp_dir}/ent/mon.csv", index=False)
    ent.iloc[50:].to_csv(f"{tmp_dir}/ent/tue.csv", index=False)
    iot = iot_frame().rename(columns={"label": "Label"})
    os.makedirs(f"{tmp_dir}/iot/DDoS", exist_ok=True)
    iot.to_csv(f"{tmp_dir}/iot/DDoS/part.csv", index=False)
    e = CSV.load_enterprise(spark, f"{tmp_dir}/ent")
    i = CSV.load_iot(spark, f"{tmp_dir}/iot")
    assert e.count() == 100 and "Label" in e.columns and "Flow Duration" in e.columns
    assert dict(e.dtypes)["Flow Duration"] == "double"
    assert "label" in i.columns and i.select("Attack_Category").distinct().first()[0] == "DDoS"
    both = CSV.load_combined([e, i])
    assert both.count() == 200
    assert {"Label", "dataset_source"} <= set(both.columns)
    assert both.groupBy("dataset_source").count().count() == 2
    assert CSV.count_rows(spark, f"{tmp_dir}/ent/mon.csv") == 50
    capped = CSV.cap_rows_per_file(e, 10)
    assert sorted(r["count"] for r in capped.groupBy("Source_File").count().collect()) == [10, 10]
    assert CSV.cap_rows(e, 7).count() == 7
    os.makedirs(f"{tmp_dir}/nolabel", exist_ok=True)
    pd.DataFrame({"a": [1], "b": [2]}).to_csv(f"{tmp_dir}/nolabel/x.csv", index=False)
    with pytest.raises(ValueError):
        CSV.load_enterprise(spark, f"{tmp_dir}/nolabel")


def test_extended_models(spark):
    df = _tiny(spark, 150)
    suite = ModelSuite(["svm", "gradient_boosting", "mlp"])
    suite.fit(df, ["f1", "f2"], "label")
    for n in suite.names:
        labels = {r["prediction"] for r in suite.predict(df, n).select("prediction").distinct().collect()}
        assert labels <= {"a", "b", "c"}
    assert len(C.ENTERPRISE_FEATURES) == 70 and len(C.IOT_FEATURES) == 46
    assert pd.Series(list(C.ENTERPRISE_FEATURES)).is_unique


def test_rows_of_one_partition_are_fitted_in_many(spark, monkeypatch):
    from flowlens.operators import models
    seen = []
    monkeypatch.setattr(models, "ROWS_A_TASK", (100, 400))
    monkeypatch.setattr(models, "fit_boosting", lambda df, *a, **k: seen.append((df.rdd.glom().map(len).collect(), df.columns)))
    df = _tiny(spark, 1000).withColumn("wide", F.lit("x" * 50)).coalesce(1)
    ModelSuite(["gradient_boosting"]).fit(df, ["f1", "f2"], "label")
    sizes, columns = seen[0]
    assert sum(sizes) == df.count() and len(sizes) > 1 and max(sizes) - min(sizes) <= 1 and columns == ["f1", "f2", "label"]


def test_a_forest_keeps_bag_counts_of_few_trees_a_row(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier as Forest
    from flowlens.operators import features
    asked, fit = [], Forest.fit
    monkeypatch.setattr(Forest, "fit", lambda self, df: (asked.append((self.getNumTrees(), self.getSeed(), self.getCacheNodeIds())), fit(self, df))[1])
    df = spark.createDataFrame([(float(i % 7), float(i % 3), "ab"[i % 7 > 3]) for i in range(200)], "x double, noise double, label string")
    got = {r.feature: r.importance for r in features.rf_importance(df, ["x", "noise"], "label", num_trees=25, max_depth=4).collect()}
    assert [a[0] for a in asked] == [10, 10, 5] and len({a[1] for a in asked}) == 3 and not any(a[2] for a in asked)
    assert got["x"] > 0.8 and abs(sum(got.values()) - 1) < 1e-3
