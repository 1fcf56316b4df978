"""Validation and data-quality checks (VAL-*).

Design rule: one aggregate for all columns, then ``unpivot`` the single row into
a long findings table ``(check, column, count, ratio, severity, message)``.
Counts of columns are map-side aggregates that shuffle one row a task. Duplicates are counted over
128-bit row hashes: two longs a row are shuffled, never the rows; the label catalogue check reads
only the label column.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import DatasetConfig
from ..functions.columns import col, finite, fractional, is_inf, numeric_columns, row_hashes
from .ranking import quantiles

FINDINGS_SCHEMA = "check string, column string, count bigint, ratio double, severity string, message string"


def _rows(spark, rows):
    return spark.createDataFrame(rows, FINDINGS_SCHEMA)


def schema_findings(df: DataFrame, cfg: DatasetConfig) -> list[tuple]:
    """VAL-01 + VAL-02: column-set checks on (stripped) header names; no data scanned."""
    cols = {c.strip() for c in df.columns}
    out = []
    missing = [f for f in cfg.features if f.strip() not in cols]
    for f in missing:
        out.append(("missing_feature", f, None, None, "error", "mandatory feature missing"))
    if cfg.label.strip() not in cols:
        out.append(("missing_label", cfg.label, None, None, "error", "required label column missing"))
    for c in sorted(cols & set(cfg.identity)):
        out.append(("leakage_column", c, None, None, "warning", "identifier column must be dropped"))
    return out


def duplicate_counts(df: DataFrame) -> DataFrame:
    """One row: ``rows`` and ``duplicate_rows`` (rows beyond the first of each distinct one; NaN equals NaN, as in pandas).

    Rows are told apart by 128-bit hashes of all columns; only the hashes are shuffled."""
    a, b = row_hashes(df, df.columns)
    # dealt by hash first: nearly all rows are distinct, and the task of a scan would hold, spill and sort their counts
    counts = df.select(a.alias("a"), b.alias("b")).repartition("a").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_rows"))


def column_findings(df: DataFrame, cfg: DatasetConfig, max_nan_ratio: float = 0.05) -> DataFrame:
    """VAL-03, VAL-05, VAL-07 in one map-side aggregate, VAL-04 over row hashes."""
    w = F.lit(1)
    numeric = numeric_columns(df)
    nonneg = [c for c in cfg.non_negative if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in numeric:
        x = col(c)
        if fractional(df, c):
            aggs.append(F.sum(F.when(is_inf(x), w).otherwise(0)).alias(f"inf|{c}"))
            aggs.append(F.sum(F.when(x.isNull() | F.isnan(x), w).otherwise(0)).alias(f"nan|{c}"))
            fin = F.when(F.isnan(x) | is_inf(x), None).otherwise(x)
        else:
            aggs.append(F.lit(0).cast("bigint").alias(f"inf|{c}"))
            aggs.append(F.sum(F.when(x.isNull(), w).otherwise(0)).alias(f"nan|{c}"))
            fin = x
        # nunique(dropna) <= 1  <=>  min == max over non-missing values (or all missing)
        aggs.append(F.coalesce(F.min(fin) == F.max(fin), F.lit(True)).cast("bigint").alias(f"const|{c}"))
    for c in nonneg:
        x = col(c).cast("double")
        aggs.append(F.sum(F.when(x < 0, w).otherwise(0)).alias(f"neg|{c}"))
    one = df.agg(*aggs)
    metric_cols = [c for c in one.columns if "|" in c]
    long = one.select("__n", F.explode(F.array(*[
        F.struct(F.lit(m.split("|", 1)[0]).alias("kind"), F.lit(m.split("|", 1)[1]).alias("column"),
                 F.col(q_(m)).cast("bigint").alias("count")) for m in metric_cols])).alias("m")) if metric_cols else \
        one.select("__n", F.explode(F.array(F.struct(F.lit("none").alias("kind"), F.lit(None).cast("string").alias("column"), F.lit(0).cast("bigint").alias("count")))).alias("m"))
    long = long.select("__n", "m.kind", "m.column", "m.count")
    ratio = F.try_divide(F.col("count").cast("double"), F.col("__n"))
    per_col = long.where(F.col("count") > 0).select(
        F.when(F.col("kind") == "inf", "infinite_values").when(F.col("kind") == "nan", "missing_values")
        .when(F.col("kind") == "neg", "negative_values").otherwise("zero_variance").alias("check"),
        "column",
        F.when(F.col("kind") == "const", F.lit(None).cast("bigint")).otherwise(F.col("count")).alias("count"),
        F.when(F.col("kind") == "const", F.lit(None).cast("double")).otherwise(ratio).alias("ratio"),
        F.when((F.col("kind") == "nan") & (ratio > max_nan_ratio), "error")
        .when(F.col("kind") == "neg", "error")
        .when(F.col("kind") == "nan", "info").otherwise("warning").alias("severity"),
        F.when(F.col("kind") == "inf", "infinite values present")
        .when((F.col("kind") == "nan") & (ratio > max_nan_ratio), "missing ratio above limit")
        .when(F.col("kind") == "nan", "missing values present")
        .when(F.col("kind") == "neg", "negative values in a non-negative column")
        .otherwise("constant column").alias("message"))
    dup = duplicate_counts(df).where(F.col("duplicate_rows") > 0).select(
        F.lit("duplicate_rows").alias("check"), F.lit(None).cast("string").alias("column"),
        F.col("duplicate_rows").cast("bigint").alias("count"),
        F.try_divide(F.col("duplicate_rows").cast("double"), F.col("rows")).alias("ratio"),
        F.lit("warning").alias("severity"), F.lit("duplicate records").alias("message"))
    return per_col.unionByName(dup)


def q_(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def label_findings(df: DataFrame, cfg: DatasetConfig) -> DataFrame:
    """VAL-06: labels outside the catalogue (warning), with row counts.

    Counted straight from the table: the scan reads only the label column and the
    shuffle carries one partial count per label per task."""
    if cfg.label not in df.columns:
        return _rows(df.sparkSession, [])
    spark = df.sparkSession
    valid = spark.createDataFrame([(v,) for v in cfg.valid_labels], "__label string")
    labels = (df.where(col(cfg.label).isNotNull())
              .groupBy(col(cfg.label).cast("string").alias("__label")).agg(F.count(F.lit(1)).alias("count")))
    bad = labels.join(F.broadcast(valid), "__label", "left_anti")  # catalogue: config-sized
    return bad.select(F.lit("invalid_label").alias("check"), F.col("__label").alias("column"),
                      F.col("count").cast("bigint").alias("count"), F.lit(None).cast("double").alias("ratio"),
                      F.lit("warning").alias("severity"), F.lit("label not in catalogue").alias("message"))


def validate(df: DataFrame, cfg: DatasetConfig, max_nan_ratio: float = 0.05) -> DataFrame:
    """VAL-08: full findings table (schema + data checks) as one lazy plan."""
    spark = df.sparkSession
    df = df.toDF(*[c.strip() for c in df.columns])
    parts = _rows(spark, schema_findings(df, cfg))
    return parts.unionByName(column_findings(df, cfg, max_nan_ratio)).unionByName(label_findings(df, cfg))


def summarize(findings: DataFrame, df: DataFrame, cfg: DatasetConfig) -> DataFrame:
    """VAL-08 summary row: is_valid, counts, valid-record ratio, clean feature count.

    Empty input is invalid; findings are reduced with one aggregate.
    """
    n = df.agg(F.count(F.lit(1)).alias("total_records"))
    s = findings.agg(
        F.coalesce(F.sum(F.when(F.col("severity") == "error", 1).otherwise(0)), F.lit(0)).alias("error_count"),
        F.coalesce(F.sum(F.when(F.col("severity") == "warning", 1).otherwise(0)), F.lit(0)).alias("warning_count"),
        F.coalesce(F.max(F.when(F.col("check") == "duplicate_rows", F.col("count"))), F.lit(0)).alias("duplicate_record_count"),
        F.coalesce(F.sum(F.when(F.col("check") == "zero_variance", 1).otherwise(0)), F.lit(0)).alias("n_zero_var"),
        F.coalesce(F.sum(F.when(F.col("check") == "leakage_column", 1).otherwise(0)), F.lit(0)).alias("n_leak"),
        F.coalesce(F.sum(F.when(F.col("check") == "infinite_values", F.col("count"))), F.lit(0)).alias("total_infinite_values"),
        F.coalesce(F.sum(F.when(F.col("check") == "missing_values", F.col("count"))), F.lit(0)).alias("total_nan_values"))
    total_features = len(df.columns)
    # two single-row aggregates folded into one row by union + max (no join)
    cols = ["error_count", "warning_count", "duplicate_record_count", "n_zero_var", "n_leak",
            "total_infinite_values", "total_nan_values"]
    both = (s.select(F.lit(None).cast("bigint").alias("total_records"), *cols)
            .unionByName(n.select("total_records", *[F.lit(None).cast("bigint").alias(c) for c in cols]))
            .agg(F.max("total_records").alias("total_records"), *[F.max(c).alias(c) for c in cols])
            .withColumn("total_features", F.lit(total_features)))
    return both.select(
        F.lit(cfg.name).alias("dataset_name"), "total_records", "total_features",
        ((F.col("error_count") == 0) & (F.col("total_records") > 0)).alias("is_valid"),
        (F.col("error_count") + F.when(F.col("total_records") == 0, 1).otherwise(0)).alias("error_count"),
        "warning_count", "duplicate_record_count", "total_infinite_values", "total_nan_values",
        F.when(F.col("total_records") > 0,
               1.0 - F.col("duplicate_record_count") / F.col("total_records")).otherwise(0.0).alias("valid_records_ratio"),
        (F.col("total_features") - F.col("n_zero_var") - F.col("n_leak")).alias("clean_features_count"))


def require_valid(findings: DataFrame) -> None:
    """VAL-09: strict gate before fitting - raise with every error (at most checks x columns)."""
    errs = findings.where(F.col("severity") == "error").orderBy("check", "column").collect()
    if errs:
        msg = "; ".join(f"{r['check']}:{r['column']}" for r in errs)
        raise ValueError(f"the flows do not pass validation ({len(errs)} errors): {msg}")


def detect_dataset_type(columns: Sequence[str], configs=None, threshold: float = 0.5) -> str | None:
    """PRJ-12 (single header): best share of required columns present, >= threshold."""
    configs = configs or C.PRESETS
    cols = {c.strip() for c in columns}
    best, best_share = None, 0.0
    for name, cfg in configs.items():
        share = sum(1 for f in cfg.features if f in cols) / len(cfg.features)
        if share > best_share:
            best, best_share = name, share
    return best if best_share >= threshold else None


def detect_dataset_types(headers: DataFrame, configs=None, threshold: float = 0.5) -> DataFrame:
    """PRJ-12 over many files: headers(file, column) x config(dataset, feature) -> best type per file.

    The config table is bounded by the presets (about 120 rows) and broadcast.
    """
    spark = headers.sparkSession
    configs = configs or C.PRESETS
    req = spark.createDataFrame([(n, f, len(c.features)) for n, c in configs.items() for f in c.features],
                                "dataset string, column string, n_required int")
    hit = (headers.select("file", F.trim("column").alias("column")).distinct()
           .join(F.broadcast(req), "column", "inner")
           .groupBy("file", "dataset").agg((F.count(F.lit(1)) / F.first("n_required")).alias("share")))
    best = hit.groupBy("file").agg(F.max_by("dataset", F.struct("share", F.col("dataset"))).alias("dataset"),
                                   F.max("share").alias("share"))
    files = headers.select("file").distinct()
    return files.join(best, "file", "left").select(
        "file", F.when(F.col("share") >= threshold, F.col("dataset")).alias("dataset_type"),
        F.coalesce("share", F.lit(0.0)).alias("share"))


def quick_profile(df: DataFrame) -> DataFrame:
    """VAL-11: rows, columns, duplicate rows, missing cells, infinite cells, dtype counts."""
    numeric = numeric_columns(df)
    frac = [c for c in numeric if fractional(df, c)]
    miss = [F.when(col(c).isNull() | (F.isnan(col(c)) if c in frac else F.lit(False)), 1).otherwise(0)
            for c in df.columns]
    infs = [F.when(is_inf(col(c)), 1).otherwise(0) for c in frac]
    cells = df.agg(F.sum(sum(miss[1:], miss[0]) if miss else F.lit(0)).alias("missing_cells"), F.sum(sum(infs[1:], infs[0]) if infs else F.lit(0)).alias("infinite_cells"))
    # two one-row aggregates folded by union and max (no join)
    none = lambda c: F.lit(None).cast("bigint").alias(c)
    both = (duplicate_counts(df).select(F.col("rows").cast("bigint"), F.col("duplicate_rows").cast("bigint"), none("missing_cells"), none("infinite_cells"))
            .union(cells.select(none("rows"), none("duplicate_rows"), F.col("missing_cells").cast("bigint"), F.col("infinite_cells").cast("bigint"))))
    prof = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return prof.select(F.col("rows").cast("bigint"), F.lit(len(df.columns)).alias("columns"),
                       F.col("duplicate_rows").cast("bigint"), F.col("missing_cells").cast("bigint"),
                       F.col("infinite_cells").cast("bigint"),
                       F.lit(len(numeric)).alias("numeric_columns"),
                       F.lit(len(df.columns) - len(numeric)).alias("other_columns"))


def missing_percent(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """VAL-13: percent missing per feature, 2 dp -> (feature, missing_pct)."""
    aggs = [F.round(100.0 * F.avg(F.when(col(f).isNull() | (F.isnan(col(f)) if fractional(df, f) else F.lit(False)), 1.0)
                                  .otherwise(0.0)), 2).alias(f) for f in features]
    one = df.agg(*aggs)
    return one.unpivot([], [col(f) for f in features], "feature", "missing_pct") if features else one


def near_zero_variance(df: DataFrame, features: Sequence[str], threshold: float = 1e-4) -> DataFrame:
    """VAL-14: sample variance below threshold -> (feature, variance, near_zero)."""
    one = df.agg(*[F.var_samp(finite(col(f))).alias(f) for f in features])
    long = one.unpivot([], [col(f) for f in features], "feature", "variance")
    return long.withColumn("near_zero", F.coalesce(F.col("variance") < threshold, F.lit(False)))


def outlier_percent(df: DataFrame, features: Sequence[str], method: str = "exact") -> DataFrame:
    """VAL-15: IQR-rule outlier percent per feature (IQR 0 -> 0), 2 dp.

    Pass 1: exact quartiles (distributed); the fences are two numbers per feature and
    are bound as literals. Pass 2: one conditional aggregate over the table.
    """
    qs = quantiles(df.select(*[finite(col(f)).alias(f) for f in features]), features, [0.25, 0.75], method=method).collect()   # feature-sized
    got: dict[str, dict[float, float]] = {}
    for r in qs:
        got.setdefault(r["feature"], {})[r["p"]] = r["q"]
    aggs, rows = [], []
    for i, f in enumerate(features):
        q1, q3 = got.get(f, {}).get(0.25), got.get(f, {}).get(0.75)
        if q1 is None or q3 is None or q3 == q1:
            rows.append((f, 0.0))          # zero IQR, or no finite values: nothing lies outside
            continue
        iqr = q3 - q1
        x = finite(col(f))
        out = (x < F.lit(q1 - 1.5 * iqr)) | (x > F.lit(q3 + 1.5 * iqr))
        aggs.append(F.round(100.0 * F.avg(F.when(out, 1.0).otherwise(0.0)), 2).alias(f"o{i}"))
    res = df.agg(*aggs).first() if aggs else None
    for i, f in enumerate(features):
        if res is not None and f"o{i}" in res.asDict():
            rows.append((f, res[f"o{i}"]))
    return df.sparkSession.createDataFrame(rows, "feature string, outlier_pct double")


def ingest_validation(spark, path: str, configs=None, max_rows: int | None = None, threshold: float = 0.5):
    """VAL-10: detect the dataset type from the header, validate the rows (all rows by
    default; the first ``max_rows`` only when asked) and return (summary row, findings).

    ``path`` is a CSV file or a folder of part files that share one header.
    The summary carries dataset_type, rows_checked, total_rows, sampled and a message.
    """
    from ..sources.csv import load_csv, upload_header
    configs = configs or C.PRESETS
    dtype = detect_dataset_type(upload_header(spark, path), configs, threshold)
    df = load_csv(spark, path)
    total = df.count()
    if dtype is None:
        msg = "Unknown dataset type: required columns not found"
        summary = spark.createDataFrame([(None, 0, total, False, False, msg)],
                                        "dataset_type string, rows_checked bigint, total_rows bigint, sampled boolean, "
                                        "is_valid boolean, message string")
        return summary, _rows(spark, [])
    cfg = configs[dtype]
    from .shape import coerce_numeric
    df = coerce_numeric(df, [f for f in cfg.features if f in df.columns])
    sampled = max_rows is not None and total > max_rows
    part = df.limit(max_rows) if sampled else df
    findings = validate(part, cfg)
    s = summarize(findings, part, cfg).first()
    checked = s["total_records"]
    msg = (f"Validated first {checked} of {total} rows" if sampled else f"Validated all {total} rows") + \
        ("" if s["is_valid"] else f"; {s['error_count']} error(s)")
    summary = spark.createDataFrame([(dtype, checked, total, sampled, bool(s["is_valid"]), msg)],
                                    "dataset_type string, rows_checked bigint, total_rows bigint, sampled boolean, "
                                    "is_valid boolean, message string")
    return summary, findings


def cleaning_report(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """VAL-12: rows / duplicates / missing and infinite cells before and after cleaning."""
    b = quick_profile(before).select(F.lit(name).alias("dataset"), F.lit("before").alias("stage"), "*")
    a = quick_profile(after).select(F.lit(name).alias("dataset"), F.lit("after").alias("stage"), "*")
    return b.unionByName(a)


def feature_quality_report(df: DataFrame, features: Sequence[str], label: str,
                           redundancy: float = 0.95, auc_threshold: float = 0.98, trees: int = 100, tree_depth: int = 30,
                           nearest: int = 3) -> DataFrame:
    """VAL-16: findings of every feature-quality check as rows, plus recommendation rows.

    Columns: (section, feature, value, detail). Sections: missing_pct, near_zero_variance,
    redundant_pair, outlier_pct, class_balance, identity_column, single_feature_leak,
    duplicate_rows, importance (random forest), mutual_information (``nearest`` neighbours), recommendation.
    """
    from . import features as FS
    from . import stats as AGG
    from ..functions.text import identity_like
    from .neighbors import neighbour_mutual_information
    spark = df.sparkSession
    schema = "section string, feature string, value double, detail string"
    parts = [
        missing_percent(df, features).select(F.lit("missing_pct").alias("section"), "feature",
                                             F.col("missing_pct").cast("double").alias("value"),
                                             F.lit(None).cast("string").alias("detail")),
        near_zero_variance(df, features).where("near_zero").select(F.lit("near_zero_variance").alias("section"), "feature",
                                                                   "variance", F.lit(None).cast("string").alias("detail")),
        AGG.redundant_pairs(AGG.correlation_pairs(df, features), redundancy).select(
            F.lit("redundant_pair").alias("section"), "feature_a", "abs_r", "feature_b"),
        outlier_percent(df, features).select(F.lit("outlier_pct").alias("section"), "feature", "outlier_pct",
                                             F.lit(None).cast("string").alias("detail")),
        AGG.value_counts(df, label).select(F.lit("class_balance").alias("section"), F.col(label).cast("string"),
                                           F.col("count").cast("double"), F.lit(None).cast("string")),
        spark.createDataFrame([(c,) for c in features], "feature string").where(identity_like(F.col("feature")))
        .select(F.lit("identity_column").alias("section"), "feature", F.lit(None).cast("double"), F.lit(None).cast("string")),
        FS.single_feature_separability(df, features, label, auc_threshold).where("flagged").select(
            F.lit("single_feature_leak").alias("section"), "feature", "auc", F.lit(None).cast("string")),
        quick_profile(df).select(F.lit("duplicate_rows").alias("section"), F.lit(None).cast("string"),
                                 F.col("duplicate_rows").cast("double"), F.lit(None).cast("string")),
        FS.rf_importance(df, features, label, num_trees=trees, max_depth=tree_depth).select(
            F.lit("importance").alias("section"), "feature", "importance", F.lit(None).cast("string")),
        neighbour_mutual_information(df, features, label, nearest).select(
            F.lit("mutual_information").alias("section"), "feature", F.round("mutual_info", 4), F.lit(None).cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out = out.toDF(*[c.split()[0] for c in schema.split(", ")])
    counts = out.groupBy("section").agg(F.count(F.lit(1)).alias("n"),
                                        F.sum(F.coalesce("value", F.lit(0.0))).alias("total"))
    rec = counts.select(
        F.lit("recommendation").alias("section"), F.col("section").alias("feature"), F.col("n").cast("double").alias("value"),
        F.when(F.col("section") == "near_zero_variance", "drop near-zero-variance features")
        .when(F.col("section") == "redundant_pair", "drop one feature of each highly correlated pair")
        .when(F.col("section") == "identity_column", "exclude identity-like columns from model input")
        .when(F.col("section") == "single_feature_leak", "verify near-perfect single features are real signals")
        .when((F.col("section") == "duplicate_rows") & (F.col("total") > 0), "investigate duplicate rows after cleaning")
        .alias("detail")).where(F.col("detail").isNotNull())
    none = rec.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0).select(
        F.lit("recommendation").alias("section"), F.lit(None).cast("string").alias("feature"),
        F.lit(None).cast("double").alias("value"), F.lit("no major feature-quality or leakage concerns").alias("detail"))
    return out.unionByName(rec).unionByName(none)
