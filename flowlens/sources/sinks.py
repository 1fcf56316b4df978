"""Sinks and persistence (SNK-*): split tables, feature contract, reports, models,
append-only result tables and the dataset registry log.

Everything is written with Spark writers to the configured (shared) file
system, so a lost executor only re-runs its own tasks.
"""
from __future__ import annotations

import json
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.fit import Params
from .csv import path_exists


def write_splits(df: DataFrame, path: str, split: str = "split", fmt: str = "parquet", mode: str = "overwrite") -> None:
    """SNK-01 / SNK-02: one table partitioned by split (train / val / test / zero_day).
    An empty split simply has no partition; readers still get the full schema."""
    df.write.mode(mode).partitionBy(split).format(fmt).save(path)


def export_contract(spark: SparkSession, path: str, features: Sequence[str], label: str, scaler: Params,
                    imputer: Params | None = None, label_index: DataFrame | None = None, seed: int = 42) -> None:
    """SNK-03: params table (JSON) + label index (JSON) + contract document."""
    scaler.to_df(spark).write.mode("overwrite").json(f"{path}/scaler")
    if imputer is not None:
        imputer.to_df(spark).write.mode("overwrite").json(f"{path}/imputer")
    if label_index is not None:
        label_index.write.mode("overwrite").json(f"{path}/label_index")
    doc = json.dumps({"features": list(features), "label": label, "scaler": scaler.kind, "seed": seed,
                      "n_features": len(features)})
    spark.createDataFrame([(doc,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")


def load_contract(spark: SparkSession, path: str) -> dict:
    """SNK-04: reload the contract, scaler params and label index."""
    doc = json.loads(spark.read.text(f"{path}/contract").first()["value"])
    doc["scaler_params"] = Params.from_df(spark.read.json(f"{path}/scaler"))
    # optional parts: absent is fine, a damaged one raises
    has = lambda part: path_exists(spark, f"{path}/{part}")
    doc["imputer_params"] = Params.from_df(spark.read.json(f"{path}/imputer")) if has("imputer") else None
    doc["label_index"] = spark.read.json(f"{path}/label_index") if has("label_index") else None
    return doc


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """SNK-05: report tables (cleaning, class distribution, importance, comparison)."""
    df.write.mode(mode).format(fmt).option("header", "true").save(path)


def save_model(model, path: str) -> None:
    """SNK-06."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """SNK-06: any saved MLlib pipeline model."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


PREDICTIONS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("classification", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("model_version", T.StringType()), T.StructField("created_at", T.TimestampType())])


def append_predictions(scored: DataFrame, path: str, model_version: str, label: str = "classification",
                       conf: str = "confidence", score: str = "anomaly_score") -> None:
    """SNK-07: append result rows only (never the features)."""
    out = scored.select(F.expr("uuid()").alias("id"), F.col(label).alias("classification"),
                        F.col(conf).cast("double").alias("confidence"), F.col(score).cast("double").alias("anomaly_score"),
                        F.lit(model_version).alias("model_version"), F.current_timestamp().alias("created_at"))
    out.write.mode("append").parquet(path)


def write_records_and_alerts(batch: DataFrame, records_path: str, alerts_path: str, id_col: str, label: str,
                             category: str = "category", severity: str = "severity", epoch: int | None = None) -> None:
    """SNK-08: one persisted batch -> traffic records table + alerts for attack rows.

    With an ``epoch`` both writes go to the partition ``epoch=<n>`` and replace it, so a batch that
    is replayed, or failed between the two writes, leaves the same rows as one that ran once."""
    from ..operators.score import alerts_from_records
    b = batch.persist()
    try:
        mode, part = ("append", "") if epoch is None else ("overwrite", f"/epoch={epoch}")
        b.write.mode(mode).parquet(records_path + part)
        alerts_from_records(b, id_col, label, category, severity).withColumn("created_at", F.current_timestamp()) \
            .write.mode(mode).parquet(alerts_path + part)
    finally:
        b.unpersist()


def evolve_schema(spark: SparkSession, path: str, required: T.StructType) -> DataFrame:
    """SNK-09: read with mergeSchema and add any missing required column as typed NULL."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    for f in required.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df


REGISTRY_SCHEMA = ("dataset_id string, name string, status string, rows bigint, dataset_type string, "
                   "is_valid boolean, validation_report string, message string, ts timestamp")


def log_status(spark: SparkSession, path: str, dataset_id: str, status: str, **fields) -> None:
    """SNK-10: append one registry event (processing / processed / invalid / failed / deleted).

    'reprocess' appends a new 'processing' event; 'delete' appends a 'deleted' tombstone.
    """
    row = {"dataset_id": dataset_id, "name": fields.get("name"), "status": status, "rows": fields.get("rows"),
           "dataset_type": fields.get("dataset_type"), "is_valid": fields.get("is_valid"),
           "validation_report": fields.get("validation_report"), "message": fields.get("message")}
    df = spark.createDataFrame([row], REGISTRY_SCHEMA.replace(", ts timestamp", "")).withColumn("ts", F.current_timestamp())
    df.write.mode("append").parquet(path)
