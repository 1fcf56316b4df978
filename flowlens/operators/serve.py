"""Serving queries over result tables (SRV-*, SORT-*, SNK-10 registry, WIN-06).

Result tables are append-only; "current state" is a latest-per-key view
(``max_by`` over a struct, one shuffle by key with map-side partial
aggregation), deletes are tombstones removed by an anti join. Listings are
top-N (TakeOrdered: a bounded heap per task) or keyset pages.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from .shape import attack_category_expr, benign_expr

STATUS_FLOW = ("processing", "processed", "invalid", "failed", "deleted")


def latest_state(log: DataFrame, key: str, ts: str, tiebreak: str | None = None,
                 payload: Sequence[str] | None = None) -> DataFrame:
    """WIN-06 / SNK-10: one row per key, the newest log entry (ties broken by ``tiebreak``).

    ``max_by`` keeps a single struct per key in the aggregation buffer, so a hot key
    costs one buffer, not a sorted window partition.
    """
    payload = list(payload) if payload is not None else [c for c in log.columns if c != key]
    order = F.struct(col(ts), *([col(tiebreak)] if tiebreak else []))
    packed = F.struct(*[col(c).alias(c) for c in payload])
    agg = log.groupBy(col(key)).agg(F.max_by(packed, order).alias("__last"))
    return agg.select(col(key), *[F.col(f"__last.{c}").alias(c) for c in payload])


def live_registry(log: DataFrame, key: str, ts: str, status: str = "status", tiebreak: str | None = None) -> DataFrame:
    """SNK-10: latest state per dataset with deleted ones removed (the last entry is the tombstone)."""
    return latest_state(log, key, ts, tiebreak).where(~col(status).eqNullSafe("deleted"))


def page(df: DataFrame, order: Sequence[F.Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """SORT-01: one page in a total order plus the total row count (``total`` column)."""
    if limit < 1:
        raise ValueError("limit must be >= 1")
    total = df.count()                      # one scalar for the response envelope
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", F.lit(total).cast("bigint"))


def top_n(df: DataFrame, order: Sequence[F.Column], n: int) -> DataFrame:
    """SORT-02 / SORT-03: newest-first or best-first top-N."""
    return df.orderBy(*order).limit(n)


def keyset_page(df: DataFrame, ts: str, key: str, cursor_ts, cursor_key, limit: int = 50) -> DataFrame:
    """SORT-06: rows strictly older than the cursor (ts, key), newest first."""
    before = (col(ts) < F.lit(cursor_ts)) | ((col(ts) == F.lit(cursor_ts)) & (col(key) < F.lit(cursor_key)))
    return df.where(before).orderBy(F.desc(ts), F.desc(key)).limit(limit)


def preview(df: DataFrame, order: Sequence[F.Column], limit: int = 10) -> DataFrame:
    """SORT-05: first-N preview, limit must be 1..50."""
    if not 1 <= limit <= 50:
        raise ValueError("preview limit must be between 1 and 50")
    return df.orderBy(*order).limit(limit)


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    """SRV-05: point lookup (pushed into the scan as a filter)."""
    return df.where(col(key) == F.lit(value))


def alerts_view(predictions: DataFrame, label: str, benign: Sequence[str] | None = None) -> DataFrame:
    """SRV-04: alerts are the non-normal predictions."""
    return predictions.where(~benign_expr(label, benign) if benign else ~benign_expr(label))


def attack_records(records: DataFrame, category: str) -> DataFrame:
    return records.where(attack_category_expr(category))


def status_counts(registry: DataFrame, status: str = "status") -> DataFrame:
    """SRV-01 helper: datasets per state."""
    return registry.groupBy(col(status)).agg(F.count(F.lit(1)).alias("datasets"))


def validation_state(registry: DataFrame, key: str, status: str = "status", report: str = "validation_report") -> DataFrame:
    """SRV-02: per dataset 'running' while processing, 'none' without a report, else the parsed report."""
    parsed = F.from_json(col(report), "map<string,string>")
    return registry.select(col(key), F.when(col(status) == "processing", "running")
                           .when(col(report).isNull(), "none").otherwise("report").alias("validation_state"),
                           parsed.alias("report"))
