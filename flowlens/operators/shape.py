"""Projection, filter and set operators (PRJ-*, FLT-*, SET-*).

All are lazy DataFrame -> DataFrame transforms built from Catalyst expressions,
so filters and projections push into the scan and stay in whole-stage codegen.
"""
from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..config import DatasetConfig
from ..functions.columns import (all_of, any_of, col, finite, fractional, grouped_values, is_inf, is_missing,
                                 numeric_columns, q, to_double)
from ..functions.text import first_path_segment, formula_guard, identity_like, identity_like_regex

# types whose equal values have equal hashes (grouped_values); nested ones may hold -0.0
HASHED_TYPES = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)

# --------------------------------------------------------------------------- PRJ


def strip_column_names(df: DataFrame) -> DataFrame:
    """PRJ-01: strip whitespace around header names."""
    return df.toDF(*[c.strip() for c in df.columns])


def standardize_column_names(df: DataFrame) -> DataFrame:
    """PRJ-02: strip, then spaces -> underscores."""
    return df.toDF(*[c.strip().replace(" ", "_") for c in df.columns])


def drop_identity(df: DataFrame, identity: Iterable[str] = C.LEAKAGE_COLUMNS) -> DataFrame:
    """PRJ-03: drop identity / leakage columns present in the frame."""
    ident = set(identity)
    return df.drop(*[c for c in df.columns if c in ident])


def drop_helper_columns(df: DataFrame, prefix: str = "__") -> DataFrame:
    """PRJ-04: drop bookkeeping columns by prefix."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """PRJ-05 (fit): columns with at most one distinct non-null value.

    ``min = max`` over finite values is the same test as ``nunique <= 1`` and needs
    only two scalars per column (one pass, no distinct sets). Returns a schema-sized list.
    """
    columns = list(columns) if columns is not None else numeric_columns(df)
    if not columns:
        return []
    aggs = []
    for c in columns:
        v = finite(col(c)) if fractional(df, c) else col(c)
        aggs.append(F.coalesce(F.min(v) == F.max(v), F.lit(True)).alias(c))
    row = df.agg(*aggs).first()
    return [c for c in columns if row[c]]


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """PRJ-05 (transform)."""
    return df.drop(*[c for c in columns if c in df.columns])


def identify_columns(df: DataFrame, label: str, exclude: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """PRJ-06: (numeric feature columns, non-numeric feature columns)."""
    ex = set(exclude) | {label}
    numeric = numeric_columns(df, ex)
    other = [c for c in df.columns if c not in ex and c not in numeric]
    return numeric, other


def coerce_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """PRJ-07: text -> double, bad values -> NULL ('Infinity' stays infinite)."""
    cols = set(columns)
    return df.select(*[to_double(col(c)).alias(c) if c in cols else col(c) for c in df.columns])


def tag(df: DataFrame, **values) -> DataFrame:
    """PRJ-08: constant tag columns (dataset name, source)."""
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df


def add_attack_category(df: DataFrame, path_col: str, root: str | None = None,
                        out: str = "Attack_Category") -> DataFrame:
    """PRJ-09: attack category = first folder below the dataset root."""
    return df.withColumn(out, first_path_segment(col(path_col), root))


def align_features(df: DataFrame, features: Sequence[str], fill: float = 0.0,
                   keep: Sequence[str] = ()) -> DataFrame:
    """PRJ-10: reorder to the contract, pad missing columns with ``fill``."""
    have = set(df.columns)
    out = [col(k) for k in keep if k in have]
    for f in features:
        out.append(F.coalesce(col(f).cast("double"), F.lit(fill)).alias(f) if f in have
                   else F.lit(float(fill)).alias(f))
    return df.select(*out)


def strict_align(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """PRJ-11: like align_features but a missing column is an error naming up to 5."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"the frame lacks {len(missing)} of the contract's columns, such as {', '.join(missing[:5])}")
    return df.select(*[col(k) for k in keep], *[col(f).cast("double").alias(f) for f in features])


def to_float32(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """PRJ-13: narrow the feature matrix to float."""
    fs = set(features)
    return df.select(*[col(c).cast("float").alias(c) if c in fs else col(c) for c in df.columns])


def payload_checks(df: DataFrame, payload_col: str, out: str = "payload_error") -> DataFrame:
    """PRJ-14: JSON feature payload contract -> parsed map + first failing rule (NULL = ok)."""
    m = F.from_json(col(payload_col), T.MapType(T.StringType(), T.StringType()))
    df = df.withColumn("__payload", m)
    keys = F.map_keys("__payload")
    vals = F.map_values("__payload")
    err = (F.when(F.col("__payload").isNull(), F.lit("payload is not a JSON object"))
           .when(F.size(keys) == 0, F.lit("features must not be empty"))
           .when(F.size(keys) > C.PAYLOAD_MAX_KEYS, F.lit(f"at most {C.PAYLOAD_MAX_KEYS} features"))
           .when(F.exists(keys, lambda k: (F.length(k) < 1) | (F.length(k) > C.PAYLOAD_MAX_KEY_LEN)),
                 F.lit(f"feature names must be 1-{C.PAYLOAD_MAX_KEY_LEN} characters"))
           .when(F.exists(vals, lambda v: F.length(v) > C.PAYLOAD_MAX_TEXT_LEN),
                 F.lit(f"text values must be at most {C.PAYLOAD_MAX_TEXT_LEN} characters")))
    return df.withColumn(out, err)


def payload_value(map_col: str, key: str) -> F.Column:
    """PRJ-15: one payload value as a finite number; bool -> 0/1; else NULL."""
    raw = F.try_element_at(F.col(map_col), F.lit(key))
    low = F.lower(F.trim(raw))
    num = raw.try_cast("double")
    return (F.when(low == "true", F.lit(1.0)).when(low == "false", F.lit(0.0))
            .when(F.isnan(num) | is_inf(num), F.lit(None).cast("double")).otherwise(num))


def payload_to_features(df: DataFrame, payload_col: str, features: Sequence[str],
                        keep: Sequence[str] = ()) -> DataFrame:
    """PRJ-14/15: payload JSON -> feature columns + error column naming the first bad key."""
    df = payload_checks(df, payload_col)
    vals = [payload_value("__payload", f).alias(f) for f in features]
    out = df.select(*[col(k) for k in keep], "payload_error", "__payload", *vals)
    missing = F.filter(F.array(*[F.lit(f) for f in features]),
                       lambda k: ~F.coalesce(F.map_contains_key(F.col("__payload"), k), F.lit(False)))
    bad_num = [F.when(F.col(q(f)).isNull() & F.col("__payload").getItem(f).isNotNull(), F.lit(f))
               for f in features]
    first_bad = F.coalesce(*bad_num) if bad_num else F.lit(None)
    err = (F.coalesce(F.col("payload_error"),
                      F.when(F.size(missing) > 0,
                             F.concat(F.lit("missing features: "), F.array_join(F.slice(missing, 1, 5), ", "))),
                      F.when(first_bad.isNotNull(), F.concat(F.lit("non-numeric or non-finite value: "), first_bad))))
    return out.withColumn("payload_error", err).drop("__payload")


# --------------------------------------------------------------------------- FLT


def replace_infinite(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """FLT-01: +-inf and NaN -> NULL on fractional columns."""
    cols = set(columns) if columns is not None else set(numeric_columns(df))
    return df.select(*[finite(col(c)).alias(c) if c in cols and fractional(df, c) else col(c)
                       for c in df.columns])


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """FLT-02: drop rows with any NULL/NaN (in ``columns`` or all)."""
    cols = list(columns) if columns is not None else df.columns
    conds = [~is_missing(col(c), fractional(df, c)) for c in cols]
    return df.where(all_of(conds))


def drop_duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """FLT-03: exact duplicate rows removed.

    Whole rows are dealt by a hash before they are compared: nearly all are distinct, so an aggregate on the side of the scan would
    hold, spill and sort all rows of a file split, and a row group cannot be split further."""
    if columns:
        return df.dropDuplicates(list(columns))
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, HASHED_TYPES)]
    if df.isStreaming or not plain:
        return df.dropDuplicates()
    return df.withColumn("__deal", F.xxhash64(*grouped_values(df, plain))).repartition("__deal").dropDuplicates().drop("__deal")


def clean_folder_frame(df: DataFrame) -> DataFrame:
    """FLT-04 (folder stack): rename -> inf to NULL -> dedup -> drop missing."""
    df = standardize_column_names(df)
    df = replace_infinite(df)
    return drop_missing(drop_duplicates(df))


def clean_merged_frame(df: DataFrame, label: str, drop_constant: bool = True) -> DataFrame:
    """FLT-04 (merged-script stack): drop helpers -> dedup -> coerce -> inf -> drop missing
    -> drop constant columns."""
    df = drop_helper_columns(df)
    df = drop_duplicates(df)
    keep_text = {label, "dataset_source"}
    numeric_like = [c for c in df.columns if c not in keep_text]
    df = coerce_numeric(df, numeric_like)
    df = replace_infinite(df, numeric_like)
    df = drop_missing(df)
    if drop_constant:
        df = drop_columns(df, constant_columns(df, numeric_like))
    return df


def clean_category_frame(df: DataFrame) -> DataFrame:
    """FLT-04 (week-1 stack): inf -> dedup -> drop missing."""
    return drop_missing(drop_duplicates(replace_infinite(df)))


def zero_day_holdout(df: DataFrame, category_col: str, zero_day: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """FLT-05: (pool without the held-out categories, held-out rows)."""
    held = F.coalesce(col(category_col).isin(list(zero_day)), F.lit(False))
    return df.where(~held), df.where(held)


def benign_expr(label_col: str, benign: Iterable[str] = C.BENIGN_TOKENS) -> F.Column:
    """FLT-07: label is benign (trim + lower-case membership)."""
    return F.lower(F.trim(col(label_col).cast("string"))).isin([b.lower() for b in benign])


def binary_target(df: DataFrame, label_col: str, out: str = "y_binary",
                  benign: Iterable[str] = C.BENIGN_TOKENS) -> DataFrame:
    """FLT-06: 1 = attack, 0 = benign."""
    return df.withColumn(out, (~benign_expr(label_col, benign)).cast("int"))


def attack_category_expr(category_col: str) -> F.Column:
    """FLT-07: category in the attack set (Other is not an attack)."""
    return F.coalesce(col(category_col).isin(list(C.ATTACK_CATEGORIES)), F.lit(False))


def benign_subset(df: DataFrame, label_col: str, benign: Iterable[str] = C.BENIGN_TOKENS) -> DataFrame:
    """FLT-08."""
    return df.where(benign_expr(label_col, benign))


def clip_to_p99(df: DataFrame, column: str, p: float = 0.99, method: str = "exact") -> DataFrame:
    """FLT-09: keep rows with min <= x <= p-th percentile (histogram input).

    The two bounds are scalars (one small aggregate each); the filter then runs as
    literals inside the scan's codegen stage.
    """
    from .ranking import quantiles
    top = quantiles(df.select(finite(col(column)).alias("x")), ["x"], [p], method=method).first()
    hi = top["q"] if top else None
    lo = df.agg(F.min(finite(col(column))).alias("m")).first()["m"]
    if hi is None or lo is None:
        return df.where(F.lit(False))
    x = finite(col(column))
    return df.where((x >= F.lit(lo)) & (x <= F.lit(hi)))


def identity_like_columns(columns: Sequence[str], spark, regex: bool = False) -> DataFrame:
    """FLT-10 / FLT-11 as a column-name table: (column, identity_like)."""
    names = spark.createDataFrame([(c,) for c in columns], "column string")
    rule = identity_like_regex(F.col("column")) if regex else identity_like(F.col("column"))
    return names.withColumn("identity_like", rule)


def sanitize(df: DataFrame, features: Sequence[str], lo: float = -10.0, hi: float = 10.0,
             keep: Sequence[str] | None = None) -> DataFrame:
    """FLT-12: NaN -> 0, +inf -> hi, -inf -> lo, clip to [lo, hi]. Missing columns raise."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"Feature shape mismatch: expected {len(features)} columns, missing {missing[:5]}")
    fs = set(features)

    def fix(c):
        x = col(c).cast("double")
        x = (F.when(x.isNull() | F.isnan(x), F.lit(0.0))
             .when(x == float("inf"), F.lit(hi)).when(x == float("-inf"), F.lit(lo)).otherwise(x))
        return F.least(F.greatest(x, F.lit(lo)), F.lit(hi)).alias(c)
    keep = [c for c in df.columns if c not in fs] if keep is None else list(keep)
    return df.select(*[col(k) for k in keep], *[fix(f) for f in features])


def guard_text_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """FLT-13: CSV formula-injection guard on text fields."""
    cs = set(columns)
    return df.select(*[formula_guard(col(c)).alias(c) if c in cs else col(c) for c in df.columns])


# --------------------------------------------------------------------------- SET


def union_on_common(a: DataFrame, b: DataFrame, forced: Sequence[str] = ()) -> DataFrame:
    """SET-01: union all on the intersection of columns (plus ``forced`` columns)."""
    common = [c for c in a.columns if c in set(b.columns)]
    for f in forced:
        if f not in common:
            common.append(f)

    def pick(df):
        return df.select(*[col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in common])
    return pick(a).unionByName(pick(b))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """SET-02: union all by name, missing columns NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def label_difference(seen: DataFrame, known: DataFrame, column: str = "label") -> DataFrame:
    """SET-04: distinct values of ``seen`` not in ``known`` (left anti)."""
    return seen.select(col(column)).distinct().join(known.select(col(column)).distinct(), column, "left_anti")


def label_union(frames: Sequence[DataFrame], column: str = "label") -> DataFrame:
    """SET-05: distinct union of label catalogues."""
    out = frames[0].select(col(column))
    for f in frames[1:]:
        out = out.union(f.select(col(column)))
    return out.distinct()


def dataset_config_columns(cfg: DatasetConfig) -> list[str]:
    return list(cfg.features) + [cfg.label]
