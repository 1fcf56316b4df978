"""End-to-end preparation plans (FIT-12, FIT-14, FIT-15): validate -> split -> fit on
train -> transform every split, returning ONE DataFrame with a ``split`` column.

Fits are single aggregates over the train rows whose results are feature-sized
parameter tables; transforms are literal arithmetic over the whole table, so
the three splits are transformed by one scan, not three.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DatasetConfig
from ..functions.columns import col
from ..operators import fit as FIT
from ..operators import labels as TAX
from ..operators import quality as VAL
from ..operators import shape as SH
from ..operators import split as SPL
from ..session import cut_lineage


@dataclass
class Prepared:
    data: DataFrame              # features (scaled), label, y, y_binary, split
    features: list[str]
    imputer: FIT.Params
    scaler: FIT.Params
    label_index: DataFrame
    dropped_constant: list[str]


def fit_transform(df: DataFrame, cfg: DatasetConfig, key: Sequence[str], scaler: str = "minmax",
                  impute: str = "median", ratios=(0.70, 0.15, 0.15), strict: bool = True, seed: int = 42,
                  consolidate: bool = False) -> Prepared:
    """FIT-14 (flow-table pipeline).

    Input that does not pass validation raises with all errors; ``strict=False`` skips that gate.
    Order per split: drop identity -> drop duplicates -> inf to NULL -> impute with
    train statistics -> drop train-constant columns -> (consolidate labels).
    Imputation values and constant columns are fitted on the raw train rows; the
    scaler and label index on the cleaned train rows.
    """
    df = SH.strip_column_names(df)
    if strict:
        VAL.require_valid(VAL.validate(df, cfg))
    feats = [f for f in cfg.features if f in df.columns]
    # the split feeds several fits (actions): materialize it once in the shared checkpoint folder
    s = cut_lineage(SPL.stratified_split(df, cfg.label, key, *ratios, seed=seed))
    base = s.select(*[col(f) for f in feats], col(cfg.label), "split")
    train_raw = base.where(F.col("split") == "train")
    imp = FIT.fit_imputer(train_raw, feats, impute)
    const = SH.constant_columns(train_raw, feats)
    clean = SH.drop_duplicates(base)          # rows are deduplicated within their split
    clean = FIT.apply_imputer(clean, imp, impute)
    clean = SH.drop_columns(clean, const)
    if consolidate and cfg.family_map:
        clean = TAX.consolidate(clean, cfg.label, cfg.family_map)
    # the cleaned rows feed the scaler fit, the label index and the output: cache them
    # (a lost block is recomputed from the short lineage after the split checkpoint)
    clean = clean.persist(StorageLevel.MEMORY_AND_DISK)
    kept = [f for f in feats if f not in const]
    train_clean = clean.where(F.col("split") == "train")
    sc = FIT.fit_scaler(train_clean, kept, scaler)
    idx = FIT.fit_label_index(train_clean, cfg.label)
    out = FIT.apply_scaler(clean, sc, keep=[cfg.label, "split"])
    out = FIT.apply_label_index(out, idx, cfg.label, "y")
    out = SH.binary_target(out, cfg.label, "y_binary", cfg.benign)
    return Prepared(out, kept, imp, sc, idx, const)


def prepare_category_stack(df: DataFrame, label: str, features: Sequence[str], zero_day: Sequence[str],
                           key: Sequence[str], category_col: str = "category", test_size: float = 0.2,
                           seed: int = 42) -> DataFrame:
    """FIT-15 (category-taxonomy stack): clean -> zero-day holdout -> encode non-numeric
    features -> population z-score fitted on the train split -> stratified 80/20.

    Encoders and scaler are fitted on train only (one encoder for every split).
    Returns rows with split in {train, test, zero_day}.
    """
    d = SH.clean_category_frame(df)
    pool, zd = SH.zero_day_holdout(d, category_col, zero_day)
    s = SPL.stratified_two_way(pool, category_col, key, test_size, seed)
    zd = zd.withColumn("split", F.lit("zero_day"))
    allrows = s.unionByName(zd)
    numeric, other = SH.identify_columns(allrows.select(*features), label="__none__")
    train = allrows.where(F.col("split") == "train")
    if other:
        enc = FIT.fit_category_encoder(train, other)
        allrows = FIT.apply_category_encoder(allrows, enc, other)
    feats = list(numeric) + list(other)
    p = FIT.fit_scaler(allrows.where(F.col("split") == "train"), feats, "standard_pop")
    return FIT.apply_scaler(allrows, p, keep=[c for c in allrows.columns if c not in set(feats)])


def prepare_merged(left: DataFrame, right: DataFrame, label: str, key: Sequence[str], benign: Sequence[str], source: str = "dataset_source",
                   test_size: float = 0.2, top_k: int | None = None, seed: int = 42) -> Prepared:
    """FIT-15 (merged stack): two datasets on their common columns -> split by binary class -> encoders, label codes,
    the ``top_k`` features of highest F and the population z-score, all fitted on the train rows.

    ``label``, ``source`` and the key are never features. Labels are trimmed; rows without one are left out; a test label that
    train does not have becomes -1, a category that train does not have the encoder's code for unknown ones. Missing and infinite values
    of numeric features become the train median. Returns rows with y, y_binary, the source and split in {train, test}."""
    from ..operators import features as FS
    merged = SH.union_on_common(left, right, forced=[label, source])
    merged = merged.withColumn(label, F.trim(col(label))).where(col(label).isNotNull())
    merged = SH.binary_target(merged, label, "y_binary", benign)
    s = cut_lineage(SPL.stratified_two_way(merged, "y_binary", key, test_size, seed))
    wanted = [c for c in merged.columns if c not in {label, source, "y_binary", *key}]
    numeric, other = SH.identify_columns(s.select(*[col(c) for c in wanted]), label="__none__")
    is_train = F.col("split") == "train"
    if other:
        s = FIT.apply_category_encoder(s, FIT.fit_category_encoder(s.where(is_train), other), other)
    imputer = FIT.fit_imputer(s.where(is_train), list(numeric), "median")
    s = FIT.apply_imputer(s, imputer)
    feats = [*numeric, *other]
    if top_k is not None:
        feats = [r["feature"] for r in FS.select_top_k(FS.anova_f(s.where(is_train), feats, label), top_k).collect()]  # at most top_k rows
    scaler = FIT.fit_scaler(s.where(is_train), feats, "standard_pop")
    index = FIT.fit_label_index(s.where(is_train), label)
    out = FIT.apply_scaler(s, scaler, keep=[label, source, "y_binary", "split", *key])
    return Prepared(FIT.apply_label_index(out, index, label, "y"), feats, imputer, scaler, index, [])
