"""Tables that change together: attempts written apart, one commit entry published last (SNK-08, SRC-10).

``SnapshotLog`` keeps, below one folder of the shared file system::

    <table>/epoch=<n>/attempt=<id>/...   rows that an attempt wrote; nobody reads them yet
    _commits/<n>.json                     the attempt of epoch n that counts, its tables and their schemas

A reader first takes the commits up to one epoch and then reads only those attempts, so it sees all tables of an epoch or none.
An attempt that fails leaves files that no commit names; a replay of a committed epoch writes nothing.
One writer commits an epoch at a time (a streaming query, or a job that owns the folder). A table keeps its partition columns.
"""
from __future__ import annotations

import json
import uuid
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.fit import Params
from ..session import open_writers
from .csv import _fs

COMMIT_SCHEMA = "epoch bigint, attempt string, tables string, about string"


class SnapshotLog:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    # -- commits

    def _commit_path(self, epoch: int) -> str:
        return f"{self.base}/_commits/{epoch:018d}.json"

    def committed(self, epoch: int) -> bool:
        p, fs = _fs(self.spark, self._commit_path(epoch))
        return bool(fs.exists(p))

    def commits(self, upto: int | None = None) -> DataFrame:
        """epoch, attempt, tables (schemas as JSON) and about of the committed epochs, read by executors."""
        p, fs = _fs(self.spark, f"{self.base}/_commits")
        if not fs.exists(p):
            return self.spark.createDataFrame([], COMMIT_SCHEMA)
        found = self.spark.read.schema(COMMIT_SCHEMA).option("pathGlobFilter", "*.json").json(f"{self.base}/_commits")
        return found if upto is None else found.where(F.col("epoch") <= upto)

    def latest(self) -> int | None:
        """The newest committed epoch: read all tables at one such number to see them together."""
        return self.commits().agg(F.max("epoch").alias("e")).first()["e"]

    def about(self, epoch: int) -> dict:
        row = self.commits().where(F.col("epoch") == epoch).first()
        return json.loads(row["about"]) if row else {}

    # -- data

    def attempt(self, epoch: int) -> Attempt:
        return Attempt(self, epoch)

    def write(self, epoch: int, tables: Mapping[str, DataFrame], about: dict | None = None, partition_by: Mapping[str, Sequence[str]] | None = None) -> bool:
        """Writes all tables of an epoch and commits them; False if the epoch is committed already."""
        if self.committed(epoch):
            return False
        a = self.attempt(epoch)
        for name, df in tables.items():
            a.put(name, df, (partition_by or {}).get(name, ()))
        a.commit(about)
        return True

    def read(self, table: str, upto: int | None = None, after: int | None = None) -> DataFrame | None:
        """Rows of the committed attempts (after < epoch <= upto) with their ``epoch``; None if no commit has the table."""
        chosen = self.commits(upto)
        if after is not None:
            chosen = chosen.where(F.col("epoch") > after)
        has = chosen.where(F.get_json_object("tables", f"$.{table}").isNotNull())
        last = has.orderBy(F.desc("epoch")).first()
        if last is None:
            return None
        schema = T.StructType.fromJson(json.loads(json.loads(last["tables"])[table]))
        full = T.StructType([*schema.fields, T.StructField("epoch", T.LongType()), T.StructField("attempt", T.StringType())])
        rows = self.spark.read.schema(full).parquet(f"{self.base}/{table}")
        # commits have one row an epoch: partitions of other attempts are pruned by the join at run time
        return rows.join(has.select("epoch", "attempt"), ["epoch", "attempt"], "left_semi").drop("attempt")


class Attempt:
    """One try at an epoch: tables are put one after another, ``commit`` publishes them together."""

    def __init__(self, log: SnapshotLog, epoch: int):
        self.log, self.epoch, self.id = log, epoch, uuid.uuid4().hex
        self.tables: dict[str, str] = {}

    def put(self, name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        """Writes a table and returns it read back (its lineage ends at the files)."""
        if not name.isidentifier():
            raise ValueError(f"a table name is letters, digits and underscores, not {name!r}")
        path = f"{self.log.base}/{name}/epoch={self.epoch}/attempt={self.id}"
        with open_writers(df.sparkSession):
            df.write.partitionBy(*partition_by).parquet(path)
        self.tables[name] = df.schema.json()
        return self.log.spark.read.schema(df.schema).parquet(path)

    def commit(self, about: dict | None = None) -> None:
        spark = self.log.spark
        row = json.dumps({"epoch": self.epoch, "attempt": self.id, "tables": json.dumps(self.tables), "about": json.dumps(about or {})})
        draft, fs = _fs(spark, f"{self.log.base}/_drafts/{self.id}.json")
        final, _ = _fs(spark, self.log._commit_path(self.epoch))
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(row.encode()))
        finally:
            stream.close()
        fs.mkdirs(final.getParent())
        # the entry appears whole or not at all
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"epoch {self.epoch} was committed by another writer")


def commit_records_and_alerts(log: SnapshotLog, batch: DataFrame, epoch: int, id_col: str, label: str, category: str = "category", severity: str = "severity") -> bool:
    """SNK-08: records of a batch and the alerts of its attack rows as one epoch; False if it was committed before.

    Alerts are derived from the written records, so both tables hold the same rows even if the batch cannot be recomputed alike."""
    from ..operators.score import alerts_from_records
    if log.committed(epoch):
        return False
    a = log.attempt(epoch)
    records = a.put("records", batch)
    a.put("alerts", alerts_from_records(records, id_col, label, category, severity).withColumn("created_at", F.current_timestamp()))
    a.commit({"id": id_col, "label": label})
    return True


def publish_training(log: SnapshotLog, version: int, splits: DataFrame, features: Sequence[str], label: str, scaler: Params,
                     imputer: Params | None = None, label_index: DataFrame | None = None, zero_day: DataFrame | None = None, split: str = "split", seed: int = 42) -> bool:
    """SNK-01..03 as one version: splits, feature contract, parameters and, if there is one, the zero-day table."""
    tables = {"splits": splits, "scaler": scaler.to_df(log.spark)}
    if imputer is not None:
        tables["imputer"] = imputer.to_df(log.spark)
    if label_index is not None:
        tables["label_index"] = label_index
    if zero_day is not None:
        tables["zero_day"] = zero_day
    about = {"features": list(features), "label": label, "split": split, "scaler": scaler.kind, "seed": seed, "n_features": len(features)}
    return log.write(version, tables, about, {"splits": [split]})


def load_training(log: SnapshotLog, version: int | None = None) -> dict:
    """SRC-10: splits, contract, parameters and the optional tables of one committed version (the newest by default).

    Keys: version, contract, splits (name -> DataFrame), scaler, imputer, label_index, zero_day; what was not published is None. Raises
    FileNotFoundError without a commit, and ValueError if a split lacks a feature of the contract or its label."""
    version = log.latest() if version is None else version
    if version is None or not log.committed(version):
        raise FileNotFoundError(f"{log.base} holds no committed version {'' if version is None else version}".rstrip())
    contract = log.about(version)
    part = lambda name: log.read(name, version, version - 1)
    splits = part("splits").drop("epoch")
    lost = [c for c in [*contract["features"], contract["label"]] if c not in splits.columns]
    if lost:
        raise ValueError(f"the splits have no column {', '.join(lost[:5])}")
    names = [r[0] for r in splits.select(contract["split"]).distinct().collect()]  # one row a split
    params = lambda name: None if part(name) is None else Params.from_df(part(name).drop("epoch"))
    table = lambda name: None if part(name) is None else part(name).drop("epoch")
    return {"version": version, "contract": contract, "splits": {n: splits.where(F.col(contract["split"]).eqNullSafe(F.lit(n))) for n in names},
            "scaler": params("scaler"), "imputer": params("imputer"), "label_index": table("label_index"), "zero_day": table("zero_day")}
