"""Attack taxonomy and label mapping (TAX-*).

The taxonomy is a small static dimension (about 50 rows); lookups are broadcast
left joins on (trimmed label, dataset) with the documented fallbacks.
"""
from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import col

TAXONOMY_SCHEMA = "raw_label string, dataset string, category string, severity string, description string"


def taxonomy(spark: SparkSession, extra: Iterable[tuple] = ()) -> DataFrame:
    """The fixed taxonomy, optionally extended with rows for other datasets."""
    return spark.createDataFrame(list(C.TAXONOMY) + list(extra), TAXONOMY_SCHEMA)


def categories(spark: SparkSession) -> DataFrame:
    """TAX-05 / TAX-06: category list with description and default severity."""
    sev = dict(C.DEFAULT_SEVERITY_BY_CATEGORY)
    return spark.createDataFrame([(i, c, d, sev[c]) for i, (c, d) in enumerate(C.CATEGORY_DESCRIPTIONS)],
                                 "ordinal int, category string, description string, default_severity string")


def map_labels(df: DataFrame, label: str, dataset: str | F.Column, tax: DataFrame | None = None,
               prefix: str = "") -> DataFrame:
    """TAX-01 + TAX-02: add category (else Other), severity (else medium), description.

    ``dataset`` is a literal name or a column (mixed-dataset frames).
    """
    tax = tax if tax is not None else taxonomy(df.sparkSession)
    ds = F.lit(dataset) if isinstance(dataset, str) else dataset
    t = tax.select(F.col("raw_label").alias("__raw"), F.col("dataset").alias("__ds"),
                   F.col("category").alias("__cat"), F.col("severity").alias("__sev"),
                   F.col("description").alias("__desc"))
    j = df.join(F.broadcast(t), (F.trim(col(label).cast("string")) == F.col("__raw")) & (ds == F.col("__ds")), "left")
    return (j.withColumn(f"{prefix}category", F.coalesce(F.col("__cat"), F.lit(C.UNKNOWN_CATEGORY)))
             .withColumn(f"{prefix}severity", F.coalesce(F.col("__sev"), F.lit(C.UNKNOWN_SEVERITY)))
             .withColumn(f"{prefix}description", F.col("__desc"))
             .drop("__raw", "__ds", "__cat", "__sev", "__desc"))


def family_map_df(spark: SparkSession, pairs: Sequence[tuple[str, str]] = C.IOT_FAMILY_MAP) -> DataFrame:
    return spark.createDataFrame(list(pairs), "raw_label string, family string")


def consolidate(df: DataFrame, label: str, pairs: Sequence[tuple[str, str]] = C.IOT_FAMILY_MAP,
                out: str | None = None) -> DataFrame:
    """TAX-03: sub-label -> family after trim; unknown labels pass through (trimmed)."""
    m = family_map_df(df.sparkSession, pairs).select(F.col("raw_label").alias("__raw"), F.col("family").alias("__fam"))
    trimmed = F.trim(col(label).cast("string"))
    j = df.join(F.broadcast(m), trimmed == F.col("__raw"), "left")
    return j.withColumn(out or label, F.coalesce(F.col("__fam"), trimmed)).drop("__raw", "__fam")


def coverage_gaps(df: DataFrame, label: str, dataset: str, tax: DataFrame | None = None) -> DataFrame:
    """TAX-04: distinct trimmed labels seen but not in the taxonomy for ``dataset``, sorted."""
    tax = tax if tax is not None else taxonomy(df.sparkSession)
    known = tax.where(F.col("dataset") == dataset).select(F.col("raw_label").alias("label"))
    seen = df.select(F.trim(col(label).cast("string")).alias("label")).where(F.col("label").isNotNull()).distinct()
    return seen.join(F.broadcast(known), "label", "left_anti").orderBy("label")


def taxonomy_for_dataset(tax: DataFrame, dataset: str) -> DataFrame:
    """TAX-05: listing for one dataset sorted by (category, raw_label)."""
    return tax.where(F.col("dataset") == dataset).orderBy("category", "raw_label")


def consolidate_with(df: DataFrame, label: str, mapping: DataFrame, out: str | None = None) -> DataFrame:
    """TAX-03 with a data-derived map (raw_label, family); Spark's own size threshold picks the join."""
    m = mapping.select(F.col("raw_label").alias("__raw"), F.col("family").alias("__fam"))
    trimmed = F.trim(col(label).cast("string"))
    j = df.join(m, trimmed == F.col("__raw"), "left")
    return j.withColumn(out or label, F.coalesce(F.col("__fam"), trimmed)).drop("__raw", "__fam")
