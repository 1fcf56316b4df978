"""Exact removal of duplicates across micro-batches, whatever the order and the delay (STR-05), and committed epochs (STR-03).

The index of rows seen so far is a table of 128-bit row hashes, partitioned by a part of the hash. An epoch reads only
the parts that its own rows touch, and only the hashes; whole rows are never compared with earlier ones. New rows, their
hashes and the newest event time are committed together (sources/snapshots.py), so a batch that runs again after
a failure sees exactly the index that it saw the first time.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, row_hashes
from ..sources.snapshots import SnapshotLog, commit_records_and_alerts

PARTS = 64


def dedup_epoch(log: SnapshotLog, batch: DataFrame, epoch: int, columns: Sequence[str] | None = None, ts: str | None = None,
                delay_seconds: float = 600.0, parts: int = PARTS) -> bool:
    """Commits the rows of a batch that no committed epoch holds; False if the epoch was committed before.

    ``columns`` make up a row's identity (all by default; the first of equal rows within a batch stays). Rows whose event time
    ``ts`` is more than ``delay_seconds`` behind the newest committed one are kept too, with ``late`` set: they form the
    side table of late rows. NULL event times are never late. The identity across epochs is the 128-bit hash."""
    if log.committed(epoch):
        return False
    own = batch.columns
    columns = list(columns or own)
    a, b = row_hashes(batch, columns)
    hashed = batch.select(*[col(c) for c in own], a.alias("__a"), b.alias("__b")).withColumn("__part", F.pmod("__a", F.lit(parts)).cast("int"))
    about = log.about(epoch_before) if (epoch_before := log.commits(epoch - 1).agg(F.max("epoch").alias("e")).first()["e"]) is not None else {}
    newest = about.get("newest")
    seconds = col(ts).cast("timestamp").cast("double") if ts else F.lit(None).cast("double")
    seen = log.read("seen", epoch - 1)
    # parts that the batch touches (at most ``parts`` numbers) and its newest event time, duplicates too, in one pass
    found = batch.select(F.pmod(a, F.lit(parts)).cast("int").alias("part"), seconds.alias("t")).agg(F.collect_set("part").alias("parts"), F.max("t").alias("t")).first()
    # rows are dealt once by their hash: duplicates within the batch and the index meet them there
    # (a row number over that order is cheaper than an aggregate, which takes the first value of each column apart)
    same = Window.partitionBy("__a", "__b").orderBy("__a")
    fresh = hashed.repartition("__a", "__b").withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")
    if seen is not None:
        seen = seen.where(F.col("__part").isin(found["parts"])) if len(found["parts"]) < parts else seen
        fresh = fresh.join(seen.select("__a", "__b"), ["__a", "__b"], "left_anti")
    late = F.coalesce(seconds < F.lit(newest) - F.lit(float(delay_seconds)), F.lit(False)) if newest is not None else F.lit(False)
    attempt = log.attempt(epoch)
    rows = attempt.put("rows", fresh.select(*[col(c) for c in own], "__a", "__b", "__part").withColumn("late", late), ["late"])
    attempt.put("seen", rows.select("__part", "__a", "__b").repartition("__part"), ["__part"])
    if ts:
        top = found["t"]
        newest = top if newest is None else newest if top is None else max(newest, top)
    attempt.commit({"newest": newest, "columns": columns, "parts": parts})
    return True


def distinct_rows(log: SnapshotLog, late: bool | None = None, upto: int | None = None) -> DataFrame | None:
    """The rows kept so far: all of them, those on time (``late=False``) or the side table of late ones; None before the first commit."""
    rows = log.read("rows", upto)
    if rows is None:
        return None
    rows = rows if late is None else rows.where(F.col("late") == late)
    return rows.drop("__a", "__b", "__part", "epoch")


def dedup_to_log(df: DataFrame, log: SnapshotLog, checkpoint: str, columns: Sequence[str] | None = None, ts: str | None = None,
                 delay_seconds: float = 600.0, parts: int = PARTS, available_now: bool = True):
    """Runs a stream through ``dedup_epoch``; the result is ``distinct_rows(log)``."""
    w = df.writeStream.foreachBatch(lambda batch, epoch: dedup_epoch(log, batch, epoch, columns, ts, delay_seconds, parts) and None)
    w = w.option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def score_to_log(df: DataFrame, log: SnapshotLog, checkpoint: str, id_col: str, label: str, category: str = "category",
                 severity: str = "severity", available_now: bool = True):
    """STR-03: every micro-batch becomes an epoch of records and alerts that readers see together."""
    w = df.writeStream.foreachBatch(lambda batch, epoch: commit_records_and_alerts(log, batch, epoch, id_col, label, category, severity) and None)
    w = w.option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
