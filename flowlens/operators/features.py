"""Feature selection, importance and security-risk analysis (FS-*).

Statistics are SQL aggregates over the flow table (one pass, class-sized
output); rankings then run on feature-sized tables.
"""
from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import col, finite, hash_order
from ..functions.text import identity_like, identity_like_regex, spoof_weight, spoofability
from ..session import cut_lineage
from .models import spread
from .ranking import average_rank_desc, long_values, mann_whitney_auc

TREES_A_FIT = 10  # MLlib keeps a bag count a row for every tree that it fits at once


def anova_f(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """FS-01: one-way ANOVA F per feature -> (feature, position, f_score).

    Per-class n, mean and population variance in one groupBy (K rows), then SSW = sum(n * var),
    SSB = sum(n * (mean - grand mean)^2) and F = (SSB/(K-1)) / (SSW/(N-K)); no raw sums of squares,
    which cancel on large values. Degenerate cases give NULL.
    """
    fs = list(features)
    per = df.where(col(label).isNotNull()).groupBy(col(label)).agg(
        *[e for f in fs for e in (F.count(finite(col(f))).alias(f"n|{f}"), F.avg(finite(col(f))).alias(f"m|{f}"),
                                  F.var_pop(finite(col(f))).alias(f"v|{f}"))])
    long = per.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f).alias("feature"), F.col(f"`n|{f}`").cast("double").alias("n"),
                 F.col(f"`m|{f}`").alias("m"), F.col(f"`v|{f}`").alias("v")) for i, f in enumerate(fs)])).alias("x")
                      ).select("x.*").where(F.col("n") > 0)
    each = Window.partitionBy("feature")  # a row per class
    long = long.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(each) / F.sum("n").over(each))
    g = long.groupBy("feature", "position").agg(
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("K"), F.sum(F.col("n") * F.col("v")).alias("ssw"),
        F.sum(F.col("n") * (F.col("m") - F.col("grand")) * (F.col("m") - F.col("grand"))).alias("ssb"))
    f_stat = F.try_divide(F.col("ssb") / (F.col("K") - 1), F.try_divide(F.col("ssw"), F.col("N") - F.col("K")))
    return g.select("feature", "position", F.when(F.col("K") > 1, f_stat).alias("f_score"))


def select_top_k(scores: DataFrame, k: int, score: str = "f_score") -> DataFrame:
    """FS-01: top-k by score (ties by position), returned in original column order."""
    w = Window.orderBy(F.desc_nulls_last(score), "position")
    return scores.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r").orderBy("position")


def rf_importance(df: DataFrame, features: Sequence[str], label: str, num_trees: int = 100, seed: int = 42,
                  max_depth: int = 30, balanced: bool = False, weight_col: str | None = None, digits: int = 4) -> DataFrame:
    """FS-02: random-forest importance per feature -> (feature, importance) sorted desc.

    Trees grow to ``max_depth`` (30 is MLlib's limit, as good as unbounded). ``balanced`` weighs rows by
    rows / (classes x rows of the class). The forest is grown ``TREES_A_FIT`` trees at a time, each fit with a seed of its own."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    clean = df.select(*[F.coalesce(finite(col(f)), F.lit(0.0)).alias(f) for f in features],
                      col(label).cast("string").alias("__lbl"), *([col(weight_col)] if weight_col else []))
    imp = 0.0
    with spread(clean) as clean:
        d = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep").transform(clean)
        d = StringIndexer(inputCol="__lbl", outputCol="__y", stringOrderType="alphabetAsc").fit(d).transform(d)
        if balanced:
            sizes = d.groupBy("__lbl").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a class
            total = sum(r["n"] for r in sizes)
            weigh = F.create_map(*[x for r in sizes for x in (F.lit(r["__lbl"]), F.lit(total / (len(sizes) * r["n"])))])
            d, weight_col = d.withColumn("__w", weigh[F.col("__lbl")]), "__w"
        for at in range(0, num_trees, TREES_A_FIT):
            rf = RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=min(TREES_A_FIT, num_trees - at), maxDepth=max_depth, seed=seed + at,
                                        maxMemoryInMB=1024, **({"weightCol": weight_col} if weight_col else {}))
            part = rf.fit(d)
            # the importances of trees that split add up to 1 each
            imp = imp + part.featureImportances.toArray() * sum(t.depth > 0 for t in part.trees)
    imp = imp / (imp.sum() or 1.0)
    rows = [(f, round(float(v), digits)) for f, v in zip(features, imp)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 10, digits: int = 4) -> DataFrame:
    """FS-03 (re-aimed): binned mutual information in nats per feature.

    Equal-width bins over [min, max] of each feature (max falls in the last bin);
    MI = sum p(x,y) ln(p(x,y) / (p(x) p(y))) over the joint counts.
    """
    long = long_values(df.select(*[finite(col(f)).alias(f) for f in features], col(label).alias("__y")),
                       features, extra=["__y"]).where(F.col("__y").isNotNull())
    rng = long.groupBy("feature").agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    b = long.join(F.broadcast(rng), "feature").withColumn(
        "bin", F.when(F.col("__hi") == F.col("__lo"), F.lit(0))
        .otherwise(F.least(F.floor((F.col("value") - F.col("__lo")) / width).cast("int"), F.lit(bins - 1))))
    joint = b.groupBy("feature", "bin", "__y").agg(F.count(F.lit(1)).alias("nxy"))
    nx = joint.groupBy("feature", "bin").agg(F.sum("nxy").alias("nx"))
    ny = joint.groupBy("feature", "__y").agg(F.sum("nxy").alias("ny"))
    n = joint.groupBy("feature").agg(F.sum("nxy").alias("n"))
    j = joint.join(nx, ["feature", "bin"]).join(ny, ["feature", "__y"]).join(n, ["feature"])
    x = lambda c: F.col(c).cast("double")  # noqa: E731  products of counts pass the range of a long
    term = (x("nxy") / x("n")) * F.ln((x("nxy") * x("n")) / (x("nx") * x("ny")))
    return j.groupBy("feature").agg(F.round(F.sum(term), digits).alias("mutual_info"))


def combined_rank(a: DataFrame, b: DataFrame, a_score: str, b_score: str, top_k: int | None = None) -> DataFrame:
    """FS-04: mean of the two descending average-tie ranks, ascending; inner join on feature."""
    ra = average_rank_desc(a.select("feature", a_score), a_score, "rank_a")
    rb = average_rank_desc(b.select("feature", b_score), b_score, "rank_b")
    j = ra.join(rb, "feature", "inner").withColumn("combined_rank", (F.col("rank_a") + F.col("rank_b")) / 2.0)
    out = j.orderBy("combined_rank", "feature")
    return out.limit(top_k) if top_k else out


def single_feature_separability(df: DataFrame, features: Sequence[str], label: str, threshold: float = 0.98,
                                digits: int = 4) -> DataFrame:
    """FS-05: direction-agnostic one-vs-rest AUC per (feature, class); max over classes.

    Returns (feature, auc, flagged) for every feature with a defined AUC.
    """
    long = long_values(df.select(*[finite(col(f)).alias(f) for f in features], col(label).cast("string").alias("__y")),
                       features, extra=["__y"]).where(F.col("__y").isNotNull())
    per = mann_whitney_auc(long, "__y")
    per = per.where(F.col("auc").isNotNull()).withColumn("auc", F.greatest("auc", 1 - F.col("auc")))
    best = per.groupBy("feature").agg(F.max("auc").alias("auc"))
    return best.select("feature", F.round("auc", digits).alias("auc"), (F.col("auc") >= threshold).alias("flagged"))


def perturbation_flip_rates(df: DataFrame, features: Sequence[str], key: Sequence[str],
                            score: Callable[[DataFrame], DataFrame], epsilon: float = 0.5, n_samples: int | None = None,
                            seed: int = 42, prediction: str = "prediction") -> DataFrame:
    """FS-06: % of predictions that flip when one feature moves by epsilon x (sample) std.

    All rows (or, if asked for, n rows in hash order) x F features -> one exploded frame -> one
    scoring pass.
    ``score`` maps a frame with the feature columns to one with ``prediction``.
    """
    fs = list(features)
    sample = df
    if n_samples is not None:
        sample = df.withColumn("__h", hash_order(key, seed)).orderBy("__h", *[col(k) for k in key]).limit(n_samples).drop("__h")
    sample = sample.withColumn("__rid", F.monotonically_increasing_id())
    # reliable checkpoint in the shared folder: row ids stay fixed for both scoring passes
    sample = cut_lineage(sample)
    stds = sample.agg(*[F.stddev_samp(col(f)).alias(f) for f in fs]).first()
    base = score(sample).select("__rid", F.col(prediction).alias("__base"))
    perturbed = sample.select("*", F.explode(F.array(*[F.lit(f) for f in fs])).alias("__feature"))
    perturbed = perturbed.select(*[c for c in sample.columns if c not in fs], "__feature",
                                 *[F.when(F.col("__feature") == f, col(f) + F.lit(epsilon * (stds[f] or 0.0)))
                                   .otherwise(col(f)).alias(f) for f in fs])
    scored = score(perturbed).select("__rid", "__feature", F.col(prediction).alias("__new"))
    j = scored.join(base, "__rid")
    rates = j.groupBy(F.col("__feature").alias("feature")).agg(
        F.round(100.0 * F.avg((F.col("__new") != F.col("__base")).cast("double")), 2).alias("flip_rate_pct"))
    zero = [f for f in fs if not stds[f]]
    return rates.withColumn("flip_rate_pct", F.when(F.col("feature").isin(zero), F.lit(0.0))
                            .otherwise(F.col("flip_rate_pct")))


def zero_day_shift(train: DataFrame, zero_day: DataFrame, features: Sequence[str], digits: int = 3) -> DataFrame:
    """FS-07: |mean_zd - mean_train| / std_train (sample std), std 0 -> 0.

    Both sides are tagged and unioned, then one conditional aggregate computes every statistic.
    """
    fs = [f for f in features if f in zero_day.columns]
    both = (train.select(*[finite(col(f)).alias(f) for f in fs], F.lit(0).alias("__zd"))
            .unionByName(zero_day.select(*[finite(col(f)).alias(f) for f in fs], F.lit(1).alias("__zd"))))
    t = F.col("__zd") == 0
    one = both.agg(F.sum(F.col("__zd")).alias("__nz"), *[e for f in fs for e in (
        F.avg(F.when(t, col(f))).alias(f"m|{f}"), F.stddev_samp(F.when(t, col(f))).alias(f"s|{f}"),
        F.avg(F.when(~t, col(f))).alias(f"z|{f}"))])
    long = one.select("__nz", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`m|{f}`").alias("m"),
                                                            F.col(f"`s|{f}`").alias("s"), F.col(f"`z|{f}`").alias("z"))
                                                   for f in fs])).alias("x")).where(F.col("__nz") > 0).select("x.*")
    shift = F.when((F.col("s") == 0) | F.col("s").isNull() | F.isnan("s"), F.lit(0.0)) \
        .otherwise(F.round(F.abs(F.col("z") - F.col("m")) / F.col("s"), digits))
    return long.select("feature", shift.alias("distribution_shift"))


def spoofability_table(names: DataFrame, feature: str = "feature") -> DataFrame:
    """FS-08: (feature, spoofability, weight)."""
    s = spoofability(col(feature))
    return names.withColumn("spoofability", s).withColumn("spoof_weight", spoof_weight(F.col("spoofability")))


def security_risk(importance: DataFrame, flips: DataFrame | None = None, shifts: DataFrame | None = None,
                  digits: int = 4) -> DataFrame:
    """FS-09: risk = norm_importance x weight, or 0.5 x that + 0.5 x flip/100 when a flip rate exists.

    importance(feature, importance) left-joined with flips(feature, flip_rate_pct) and
    shifts(feature, distribution_shift); importance normalised by its max (max 0 -> 1).
    """
    mx = F.max("importance").over(Window.partitionBy())  # feature-sized table
    d = importance.withColumn("__max", mx)
    d = d.withColumn("norm_importance", F.col("importance") / F.when(F.col("__max") == 0, 1.0).otherwise(F.col("__max")))
    d = spoofability_table(d)
    if flips is not None:
        d = d.join(flips, "feature", "left")
    else:
        d = d.withColumn("flip_rate_pct", F.lit(None).cast("double"))
    if shifts is not None:
        d = d.join(shifts, "feature", "left")
    else:
        d = d.withColumn("distribution_shift", F.lit(None).cast("double"))
    base = F.col("norm_importance") * F.col("spoof_weight")
    risk = F.when(F.col("flip_rate_pct").isNotNull(), 0.5 * base + 0.5 * (F.col("flip_rate_pct") / 100.0)).otherwise(base)
    return d.select("feature", F.round("norm_importance", digits).alias("importance"), "spoofability",
                    "flip_rate_pct", "distribution_shift", F.round(risk, digits).alias("risk_score"))


def risk_findings(risk: DataFrame, top: int = 20, names: int = 5) -> DataFrame:
    """FS-10: finding rows over the top-``top`` risk features (count + first names)."""
    w = Window.orderBy(F.desc("risk_score"), "feature")
    t = risk.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= top)
    rules = [("controllable_and_important", (F.col("spoofability") == C.SPOOF_CONTROLLABLE) & (F.col("importance") > 0.3)),
             ("easily_flipped", F.coalesce(F.col("flip_rate_pct") > 20, F.lit(False))),
             ("zero_day_shift", F.coalesce(F.col("distribution_shift") > 1.0, F.lit(False)))]
    parts = None
    for name, cond in rules:
        p = t.where(cond).agg(F.lit(name).alias("finding"), F.count(F.lit(1)).alias("n_features"),
                              F.slice(F.transform(F.array_sort(F.collect_list(F.struct("__r", "feature"))),
                                                  lambda s: s["feature"]), 1, names).alias("examples"))
        parts = p if parts is None else parts.unionByName(p)
    return parts


def feature_reliance(importance: DataFrame, top_k: int = 15, regex: bool = True) -> DataFrame:
    """FS-11: top-k importances with an identity-like flag."""
    flag = identity_like_regex(F.col("feature")) if regex else identity_like(F.col("feature"))
    return importance.orderBy(F.desc("importance"), "feature").limit(top_k).withColumn("identity_like", flag)
