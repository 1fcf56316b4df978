"""Truth joined with predictions on a real key (JOIN-04).

Truth and predictions are usually written apart, by different jobs. Written with
``write_keyed`` (buckets by the key, sorted), both sides are grouped by key and joined without
a shuffle: the buckets of the two tables meet where they lie.
"""
from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import scratch_path

STATES = ("paired", "only_truth", "only_prediction", "repeated_truth", "repeated_prediction", "repeated_both")


def write_keyed(df: DataFrame, keys: Sequence[str], path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Writes ``df`` bucketed and sorted by ``keys`` and returns it read back, with its buckets.

    Buckets are known to Spark through a catalog entry; the entry is dropped again, the files
    (at ``path``, by default in the checkpoint folder) stay."""
    spark = df.sparkSession
    name = f"keyed_{uuid.uuid4().hex}"
    path = path or scratch_path(spark, "keyed")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = list(keys)
    # one task a bucket writes one file a bucket
    (df.repartition(n, *[col(k) for k in keys]).write.bucketBy(n, *keys).sortBy(*keys)
     .option("path", path).format("parquet").saveAsTable(name))
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def pair_predictions(truth: DataFrame, predictions: DataFrame, keys: Sequence[str], label: str, prediction: str) -> DataFrame:
    """One row per key: ``n_truth``, ``n_prediction``, ``truth`` and ``prediction`` (where the side has one row), ``state``.

    States: ``paired`` (one row on either side), ``only_truth``, ``only_prediction``, ``repeated_truth``,
    ``repeated_prediction``, ``repeated_both``. Rows are grouped by key first, so a repeated key never multiplies rows.
    A key with a NULL part matches nothing."""
    keys = list(keys)
    side = lambda df, value, n, out: df.groupBy(*[col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias(n), F.max(col(value)).alias(out))
    t, p = side(truth, label, "n_truth", "truth"), side(predictions, prediction, "n_prediction", "prediction")
    both = t.join(p, keys, "full")
    none_t, none_p = F.col("n_truth").isNull(), F.col("n_prediction").isNull()
    many_t, many_p = F.col("n_truth") > 1, F.col("n_prediction") > 1
    state = (F.when(none_p, "only_truth").when(none_t, "only_prediction").when(many_t & many_p, "repeated_both")
             .when(many_t, "repeated_truth").when(many_p, "repeated_prediction").otherwise("paired"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return both.select(*[col(k) for k in keys], zero("n_truth"), zero("n_prediction"),
                       F.when(~many_t, F.col("truth")).alias("truth"), F.when(~many_p, F.col("prediction")).alias("prediction"), state.alias("state"))


def pairing_report(pairs: DataFrame) -> DataFrame:
    """Keys and rows of either side by state (every state, also those without keys)."""
    states = pairs.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    found = pairs.groupBy("state").agg(F.count(F.lit(1)).alias("keys"), F.sum("n_truth").alias("truth_rows"), F.sum("n_prediction").alias("prediction_rows"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return states.join(found, "state", "left").select("state", zero("keys"), zero("truth_rows"), zero("prediction_rows"))
