"""Driver tables and their deterministic 'dirty' variants (stand-ins for flow data).

The tables hold no NULL / NaN / inf / duplicate rows, so data-quality operators
get dirt injected by fixed key rules, identically here and in the oracle SQL.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dirty_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with NULL quantity, +-inf price, NaN discount and re-appended duplicate rows."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    d = li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(k % 89 == 0, F.lit(None).cast("double")).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(k % 97 == 0, F.lit(float("inf"))).when(k % 103 == 0, F.lit(float("-inf")))
        .otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when(k % 101 == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("l_discount"),
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    return d.unionByName(d.where(k % 113 == 0))


FLOWS_SQL = """flows AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
    CASE WHEN l_orderkey % 97 = 0 THEN 'Infinity'::DOUBLE WHEN l_orderkey % 103 = 0 THEN '-Infinity'::DOUBLE
         ELSE l_extendedprice END AS l_extendedprice,
    CASE WHEN l_orderkey % 101 = 0 THEN 'NaN'::DOUBLE ELSE l_discount END AS l_discount,
    l_tax, l_returnflag, l_linestatus, l_shipdate
  FROM lineitem),
flows_all AS (SELECT * FROM flows UNION ALL SELECT * FROM flows WHERE l_orderkey % 113 = 0)"""


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with +inf / NaN / NULL values."""
    ev = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return ev.select("event_id", "ts", "user_id", "event_type",
                     F.when(k % 97 == 0, F.lit(float("inf"))).when(k % 89 == 0, F.lit(float("nan")))
                     .when(k % 83 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"),
                     "props")


EVENTS_SQL = """ev AS (
  SELECT event_id, ts, user_id, event_type,
    CASE WHEN event_id % 97 = 0 THEN 'Infinity'::DOUBLE WHEN event_id % 89 = 0 THEN 'NaN'::DOUBLE
         WHEN event_id % 83 = 0 THEN NULL ELSE value END AS value, props
  FROM events)"""

# Stand-in taxonomy rows for the events table (our own mapping, not reference data):
# 'signup' is left out on purpose so the Other / medium fallback is exercised.
EVENTS_TAXONOMY = (
    ("click", "events", "Normal", "none", "Ordinary interaction."),
    ("view", "events", "Normal", "none", "Ordinary interaction."),
    ("purchase", "events", "Normal", "none", "Ordinary interaction."),
    ("error", "events", "DoS", "high", "Failure burst treated as an attack class."),
)

EVENTS_TAXONOMY_SQL = """tax AS (SELECT * FROM (VALUES
  ('click', 'events', 'Normal', 'none'), ('view', 'events', 'Normal', 'none'),
  ('purchase', 'events', 'Normal', 'none'), ('error', 'events', 'DoS', 'high'))
  AS t(raw_label, dataset, category, severity))"""
