"""Fit / transform operators: impute, scale, encode (FIT-*).

A fit is one aggregate over the training rows that yields a *params table* with
one row per feature (schema-sized, never data-sized). Transform inlines those
numbers as literals, so the scaled projection is plain arithmetic inside the
scan's whole-stage-codegen stage: no join, no Python, no broadcast of data.
Category encoders are (column, value, code) tables joined back, broadcast only
behind a size check.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import col, finite, fractional, one_if_zero
from .ranking import quantiles, sent_if_few

PARAMS_SCHEMA = "feature string, stat string, value double"


@dataclass
class Params:
    """Fitted per-feature numbers: {feature: {stat: value}} plus provenance."""
    kind: str
    values: dict[str, dict[str, float]] = field(default_factory=dict)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(f, s, float(v) if v is not None else None) for f, d in self.values.items() for s, v in d.items()]
        return spark.createDataFrame(rows, PARAMS_SCHEMA).withColumn("kind", F.lit(self.kind))

    @staticmethod
    def from_df(df: DataFrame) -> "Params":
        rows = df.collect()  # params table: one row per (feature, stat)
        kind = rows[0]["kind"] if rows else "none"
        out: dict[str, dict[str, float]] = {}
        for r in rows:
            out.setdefault(r["feature"], {})[r["stat"]] = r["value"]
        return Params(kind, out)


def _clean(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select(*[finite(col(f)).alias(f) if fractional(df, f) else col(f).cast("double").alias(f)
                       for f in features])


def fit_imputer(df: DataFrame, features: Sequence[str], strategy: str = "median",
                method: str = "exact") -> Params:
    """FIT-01: per-feature fill value from finite values (inf excluded).

    ``median`` is exact (distributed two-level scan) unless method='approx';
    ``mean`` is avg; any other strategy stores 0.0 (and 'drop' drops rows at transform).
    """
    clean = _clean(df, features)
    if strategy == "median":
        qs = quantiles(clean, features, [0.5], method=method).collect()  # one row per feature
        vals = {r["feature"]: r["q"] for r in qs}
        return Params("impute_median", {f: {"impute": vals.get(f)} for f in features})
    if strategy == "mean":
        row = clean.agg(*[F.avg(col(f)).alias(f) for f in features]).first()
        return Params("impute_mean", {f: {"impute": row[f]} for f in features})
    return Params(f"impute_{strategy}", {f: {"impute": 0.0} for f in features})


def apply_imputer(df: DataFrame, params: Params, strategy: str = "median") -> DataFrame:
    """FIT-02: inf -> NULL, then fill with the learned value (all-NULL training column -> stays NULL).

    ``drop`` strategy drops rows with any missing feature instead.
    """
    feats = [f for f in params.values if f in df.columns]
    out = df.select(*[finite(col(c)).alias(c) if c in feats and fractional(df, c) else col(c) for c in df.columns])
    if strategy == "drop":
        return out.dropna(subset=feats)
    fills = {f: d["impute"] for f, d in params.values.items() if f in feats and d.get("impute") is not None}
    return out.fillna(fills) if fills else out


def fit_imputer_on_batch(df: DataFrame, features: Sequence[str], strategy: str = "median") -> DataFrame:
    """FIT-02 fallback (unfitted): statistics computed on the batch itself, NaN stat -> 0."""
    p = fit_imputer(df, features, strategy)
    for d in p.values.values():
        if d["impute"] is None:
            d["impute"] = 0.0
    return apply_imputer(df, p, strategy)


def fit_scaler(df: DataFrame, features: Sequence[str], kind: str = "minmax", method: str = "exact") -> Params:
    """FIT-04/05/06/07: scaler parameters from one aggregate (plus one quantile pass for robust).

    minmax: min, diff (0 -> 1); standard: mean, sample std (0 -> 1);
    standard_pop: mean, population std (0 -> 1); robust: median, IQR (0 -> 1).
    """
    clean = _clean(df, features)
    if kind == "minmax":
        row = clean.agg(*[e for f in features for e in (F.min(col(f)).alias(f"a|{f}"), F.max(col(f)).alias(f"b|{f}"))]).first()
        vals = {}
        for f in features:
            lo, hi = row[f"a|{f}"], row[f"b|{f}"]
            diff = (hi - lo) if (lo is not None and hi is not None and hi != lo) else 1.0
            vals[f] = {"min": lo, "diff": diff}
        return Params("minmax", vals)
    if kind in ("standard", "standard_pop"):
        sd = F.stddev_samp if kind == "standard" else F.stddev_pop
        row = clean.agg(*[e for f in features for e in (F.avg(col(f)).alias(f"m|{f}"), sd(col(f)).alias(f"s|{f}"))]).first()
        vals = {}
        for f in features:
            s = row[f"s|{f}"]
            vals[f] = {"mean": row[f"m|{f}"], "std": s if (s is not None and s != 0 and s == s) else 1.0}
        return Params(kind, vals)
    if kind == "robust":
        qs = quantiles(clean, features, [0.25, 0.5, 0.75], method=method).collect()
        got: dict[str, dict[float, float]] = {}
        for r in qs:
            got.setdefault(r["feature"], {})[r["p"]] = r["q"]
        vals = {}
        for f in features:
            g = got.get(f, {})
            q1, med, q3 = g.get(0.25), g.get(0.5), g.get(0.75)
            iqr = (q3 - q1) if (q1 is not None and q3 is not None and q3 != q1) else 1.0
            vals[f] = {"median": med, "iqr": iqr}
        return Params("robust", vals)
    raise ValueError(f"Unsupported scaler '{kind}'. Choose minmax, standard, standard_pop or robust.")


def scale_expr(f: str, params: Params) -> F.Column:
    """Scaled value of one feature as a literal-only expression."""
    p = params.values[f]
    x = col(f).cast("double")
    if params.kind == "minmax":
        v = (x - F.lit(p["min"])) / F.lit(p["diff"])
        return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    if params.kind in ("standard", "standard_pop"):
        return (x - F.lit(p["mean"])) / F.lit(p["std"])
    if params.kind == "robust":
        return (x - F.lit(p["median"])) / F.lit(p["iqr"])
    raise ValueError(params.kind)


def apply_scaler(df: DataFrame, params: Params, keep: Sequence[str] | None = None, fill_missing: float = 0.0) -> DataFrame:
    """FIT-04..08 transform: features in contract order; a feature absent from the frame -> ``fill_missing``."""
    feats = list(params.values)
    keep = [c for c in df.columns if c not in set(feats)] if keep is None else list(keep)
    out = [col(k) for k in keep]
    for f in feats:
        out.append(scale_expr(f, params).alias(f) if f in df.columns else F.lit(float(fill_missing)).alias(f))
    return df.select(*out)


def zscore_pop_fill(df: DataFrame, features: Sequence[str], keep: Sequence[str] | None = None) -> tuple[DataFrame, Params]:
    """FIT-07: inf/NaN -> 0 first, then population z-score (0 std -> 1)."""
    filled = df.select(*[F.coalesce(finite(col(c)), F.lit(0.0)).alias(c) if c in set(features) else col(c)
                         for c in df.columns])
    p = fit_scaler(filled, features, "standard_pop")
    return apply_scaler(filled, p, keep), p


def apply_stored_scaler(df: DataFrame, center: Sequence[float], scale: Sequence[float], features: Sequence[str],
                        keep: Sequence[str] = ()) -> DataFrame:
    """FIT-08: apply a stored center/scale contract; scale 0 -> 1; length mismatch is an error."""
    if not (len(center) == len(scale) == len(features)):
        raise ValueError(f"scaler length mismatch: {len(center)} centers, {len(scale)} scales, {len(features)} features")
    out = [col(k) for k in keep]
    for f, c, s in zip(features, center, scale):
        out.append(((col(f).cast("double") - F.lit(float(c))) / F.lit(float(s) if s else 1.0)).alias(f))
    return df.select(*out)


def check_scaling(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """FIT-13: max |mean| and max |std - 1| across scaled features (one aggregate)."""
    one = df.agg(*[e for f in features for e in (F.avg(col(f)).alias(f"m|{f}"), F.stddev_pop(col(f)).alias(f"s|{f}"))])
    return one.select(F.greatest(*[F.abs(F.col(f"`m|{f}`")) for f in features]).alias("max_abs_mean"),
                      F.greatest(*[F.abs(F.col(f"`s|{f}`") - 1) for f in features]).alias("max_abs_std_dev"))


# --------------------------------------------------------------------------- encoders


def fit_label_index(df: DataFrame, label: str) -> DataFrame:
    """FIT-09 fit: sorted distinct labels -> 0..k-1, as a (label, idx) table (distributed ranking)."""
    from .ranking import rank_distinct
    d = df.select(col(label).cast("string").alias(label))
    return rank_distinct(d, [], label, "idx")


def apply_label_index(df: DataFrame, index: DataFrame, label: str, out: str = "y") -> DataFrame:
    """FIT-09 transform: unseen labels -> -1. An index of few labels is sent to all tasks."""
    idx = sent_if_few(index.select(col(label).alias("__lbl"), F.col("idx").alias("__idx")))
    j = df.join(idx, col(label).cast("string") == F.col("__lbl"), "left")
    return j.withColumn(out, F.coalesce(F.col("__idx"), F.lit(-1))).drop("__lbl", "__idx")


def decode_index(df: DataFrame, index: DataFrame, label: str, idx_col: str, out: str) -> DataFrame:
    """FIT-11: index -> class name, fallback ``Class_i``."""
    m = sent_if_few(index.select(F.col("idx").alias("__i"), col(label).alias("__name")))
    j = df.join(m, F.col(idx_col) == F.col("__i"), "left")
    return j.withColumn(out, F.coalesce(F.col("__name"), F.concat(F.lit("Class_"), F.col(idx_col).cast("string")))) \
        .drop("__i", "__name")


def fit_category_encoder(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """FIT-10 fit: one table (column, value, code) for all non-numeric features, codes by sorted value."""
    from .ranking import rank_distinct
    parts = None
    for c in columns:
        d = df.select(F.lit(c).alias("column"), col(c).cast("string").alias("value"))
        parts = d if parts is None else parts.unionByName(d)
    if parts is None:
        return df.sparkSession.createDataFrame([], "column string, value string, code int")
    return rank_distinct(parts, ["column"], "value", "code")


def apply_category_encoder(df: DataFrame, encoder: DataFrame, columns: Sequence[str]) -> DataFrame:
    """FIT-10 transform: replace each column by its code (unseen -> -1)."""
    out = df
    for c in columns:
        e = sent_if_few(encoder.where(F.col("column") == c).select(F.col("value").alias("__v"), F.col("code").alias("__code")))
        out = out.join(e, col(c).cast("string") == F.col("__v"), "left") \
            .withColumn(c, F.coalesce(F.col("__code"), F.lit(-1))).drop("__v", "__code")
    return out
