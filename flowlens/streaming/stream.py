"""Structured Streaming (STR-*): the batch transforms applied to arriving files.

Fitted parameters are frozen into literal expressions before the query starts
(a stream cannot be started without them); each micro-batch is then a plain
projection, so streaming output equals batch output row for row. Cross-batch
duplicates are removed with ``dropDuplicatesWithinWatermark`` keyed on the row values.
"""
from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import fit as FIT
from ..operators import shape as SH
from ..session import state_on_disk


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int = 1) -> DataFrame:
    """STR-01 source: new files in a folder become micro-batches."""
    return (spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .option("header", "true").load(path))


def fitted_transform(imputer: FIT.Params | None, scaler: FIT.Params | None, label: str | None = None,
                     keep: Sequence[str] = (), benign: Sequence[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """STR-02: refuse to build a streaming transform before the pipeline is fitted."""
    if scaler is None:
        raise RuntimeError("fit a scaler first: a stream is transformed with parameters that are already known")

    def run(df: DataFrame) -> DataFrame:
        out = df
        if imputer is not None:
            out = FIT.apply_imputer(out, imputer)
        out = FIT.apply_scaler(out, scaler, keep=[*keep, *([label] if label else [])])
        if label:
            out = SH.binary_target(out, label, "y_binary", benign) if benign else SH.binary_target(out, label, "y_binary")
        return out
    return run


def dedup_stream(df: DataFrame, ts: str | None, columns: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    """STR-05: cross-batch duplicate removal with state bounded by a watermark.

    The state is keyed on the row values themselves (not a hash), so two distinct
    rows can never collide and be dropped.

    ``ts`` None: the watermark follows the time of arrival. No row is ever late, so none is lost;
    a duplicate is removed if it arrives within ``delay`` of the first one, and passes after it.
    With an event-time column, rows more than ``delay`` behind the newest event are late and
    dropped by Spark even if they are distinct: use it only for sources in order of time.
    """
    # watermarks need TIMESTAMP (local time zone); parquet without zone info reads as TIMESTAMP_NTZ
    when = F.current_timestamp() if ts is None else F.col(SH.q(ts)).cast("timestamp")
    d = df.withColumn("__event_time", when)
    return d.withWatermark("__event_time", delay).dropDuplicatesWithinWatermark(list(columns)).drop("__event_time")


def to_table(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True):
    """Run into a file table in the shared folder (exactly-once with the checkpoint).

    State, such as the rows of ``dedup_stream``, is kept on disk: the heap need not hold every row of the delay."""
    w = (df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
         .outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w
    with state_on_disk(df.sparkSession):
        return w.start()


def score_and_persist(df: DataFrame, records_path: str, alerts_path: str, checkpoint: str, id_col: str, label: str,
                      category: str = "category", severity: str = "severity", available_now: bool = True):
    """STR-03 / SNK-08: each micro-batch writes its part of the records and alerts tables; a batch
    that runs again after a failure replaces its own part."""
    from ..sources.sinks import write_records_and_alerts

    def each(batch: DataFrame, epoch_id: int) -> None:
        write_records_and_alerts(batch, records_path, alerts_path, id_col, label, category, severity, epoch=epoch_id)
    w = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def throughput(query) -> dict:
    """STR-04: rows/s over the query's recorded progress (processed rows / batch duration)."""
    rows, ms = 0, 0
    for p in query.recentProgress:
        rows += p.get("numInputRows", 0) if isinstance(p, dict) else p.numInputRows
        d = p.get("durationMs", {}) if isinstance(p, dict) else p.durationMs
        ms += (d or {}).get("triggerExecution", 0)
    return {"rows": rows, "seconds": ms / 1000.0, "rows_per_sec": (rows / (ms / 1000.0)) if ms else None}
