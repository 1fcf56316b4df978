"""The distributed order-statistics kernel against brute force on small fixtures."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens.operators import ranking as R


def _frame(spark, seed=7, n=600):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "g": rng.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1]),
        "x": np.round(rng.normal(0, 3, n), 1),          # many ties
        "y": rng.exponential(2.0, n),
        "label": rng.choice(["p", "q"], n)})
    return pdf, spark.createDataFrame(pdf)


def test_prefix_sums_match_cumsum(spark):
    pdf, df = _frame(spark)
    vc = df.groupBy("g", "x").agg(F.count(F.lit(1)).alias("cnt"))
    got = R.prefix_sums(vc, ["g"], "x", ["cnt"]).toPandas().sort_values(["g", "x"])
    exp = pdf.groupby(["g", "x"]).size().rename("cnt").reset_index().sort_values(["g", "x"])
    exp["below"] = exp.groupby("g")["cnt"].cumsum() - exp["cnt"]
    assert got["cnt_below"].tolist() == exp["below"].tolist()


def test_global_prefix_sums(spark):
    pdf, df = _frame(spark)
    vc = df.groupBy("x").agg(F.count(F.lit(1)).alias("cnt"))
    got = R.prefix_sums(vc, [], "x", ["cnt"]).toPandas().sort_values("x")
    exp = pdf.groupby("x").size().sort_index()
    assert got["cnt_below"].tolist() == (exp.cumsum() - exp).tolist()


def test_exact_quantiles_match_numpy(spark):
    pdf, df = _frame(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = R.quantiles(df, ["x", "y"], probs, by=["g"]).toPandas()
    for (g, f), part in got.groupby(["g", "feature"]):
        vals = pdf.loc[pdf.g == g, f].to_numpy()
        for p, q in zip(part["p"], part["q"]):
            assert q == pytest.approx(np.percentile(vals, p * 100), rel=1e-12, abs=1e-12)


def test_auc_matches_pairwise_count(spark):
    pdf, df = _frame(spark, n=300)
    long = R.long_values(df, ["x"], extra=["label"])
    got = {r["label"]: r["auc"] for r in R.mann_whitney_auc(long, "label").collect()}
    pos = pdf.loc[pdf.label == "p", "x"].to_numpy()
    neg = pdf.loc[pdf.label != "p", "x"].to_numpy()
    diff = pos[:, None] - neg[None, :]
    brute = ((diff > 0).sum() + 0.5 * (diff == 0).sum()) / diff.size
    assert got["p"] == pytest.approx(brute, rel=1e-12)
    assert got["q"] == pytest.approx(1 - brute, rel=1e-12)


def test_average_rank_desc_ties(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 3.0), ("d", 2.0)], "feature string, s double")
    got = {r["feature"]: r["rk"] for r in R.average_rank_desc(df, "s", "rk").collect()}
    assert got == {"a": 1.5, "c": 1.5, "d": 3.0, "b": 4.0}


def test_rank_distinct_strings(spark):
    import random
    rnd = random.Random(3)
    vals = ["".join(rnd.choice("abcxyzé09") for _ in range(rnd.randint(0, 9))) for _ in range(400)]
    df = spark.createDataFrame([(("g1" if i % 3 else "g2"), v) for i, v in enumerate(vals)], "k string, v string")
    got = {(r["k"], r["v"]): r["code"] for r in R.rank_distinct(df, ["k"], "v").collect()}
    for k in ("g1", "g2"):
        # Spark orders strings by UTF-8 bytes
        exp = sorted({v for i, v in enumerate(vals) if ("g1" if i % 3 else "g2") == k}, key=lambda s: s.encode())
        assert [got[(k, v)] for v in exp] == list(range(len(exp)))


def test_hash_positions_match_sorted_order(spark):
    import hashlib
    from flowlens.operators.split import positions
    rows = [(i, ["x", "y", "z"][i % 3]) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, g string")
    got = {r["k"]: r["__pos"] for r in positions(df, ["k"], ["g"]).collect()}
    for g in ("x", "y", "z"):
        ks = sorted((k for k, gg in rows if gg == g), key=lambda k: (hashlib.md5(f"{k}:42".encode()).hexdigest(), k))
        assert [got[k] for k in ks] == list(range(len(ks)))
    glob = {r["k"]: r["__pos"] for r in positions(df, ["k"]).collect()}
    ks = sorted((k for k, _ in rows), key=lambda k: hashlib.md5(f"{k}:42".encode()).hexdigest())
    assert [glob[k] for k in ks] == list(range(len(ks)))


def test_null_group_is_a_group(spark):
    rows = [(g, float(i)) for i in range(40) for g in ("a", None, "b")]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r["g"]): r["q"] for r in R.quantiles(df, ["x"], [0.5], by=["g"]).collect()}
    assert got == {"a": 19.5, "b": 19.5, None: 19.5}


def test_codes_of_strings_with_a_long_common_prefix(spark):
    vals = [f"Customer#{i:06d}" for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in reversed(vals)], "v string").repartition(5)
    got = {r["v"]: r["code"] for r in R.rank_distinct(df, [], "v").collect()}
    assert got == {v: i for i, v in enumerate(vals)}


def test_cuts_by_hash_equal_the_sorted_order(spark):
    """Classes of any size, a NULL class, and equal keys that straddle a cut."""
    import hashlib
    from flowlens.operators.split import first_in_hash_order, stratified_cap
    rows = [(i, ["x", None, "z"][i % 3], i) for i in range(300)] + [(7000 + i // 9, "t", 300 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, g string, row long").repartition(4)
    out = first_in_hash_order(df, ["k"], ["g"], [lambda n: F.floor(n * 0.3), lambda n: n - 5, lambda n: n + 1]).collect()
    for g in ("x", None, "z", "t"):
        order = sorted((hashlib.md5(f"{k}:42".encode()).hexdigest()) for k, gg, _ in rows if gg == g)
        n = len(order)
        for i, rank in enumerate((int(n * 0.3), n - 5, n)):
            got = sorted(hashlib.md5(f"{r['k']}:42".encode()).hexdigest() for r in out if r["g"] == g and r[f"__in{i}"])
            assert got == order[:rank]
    for cap in (1000, 339, 100):
        kept = stratified_cap(df, "g", ["k"], cap).collect()
        share = min(1.0, cap / len(rows))
        assert len(kept) == sum(int(n * share) for n in (100, 100, 100, 40))
        assert any(r["g"] is None for r in kept)


def test_area_of_counts_beyond_three_billion(spark):
    n = 4_000_000_000
    s = spark.createDataFrame([("f", 1, float(n) * (n + 1) / 2 + float(n) * n, n), ("f", 0, float(n) * (n + 1) / 2, n)],
                              "feature string, y int, rank_sum double, n_pos long")
    got = {r["y"]: r["auc"] for r in R.auc_of_rank_sums(s, ["feature"]).collect()}
    assert got[1] == pytest.approx(1.0) and got[0] == pytest.approx(0.0, abs=1e-9)


def test_anova_of_large_values(spark):
    from flowlens.operators.features import anova_f
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 6, 300)
    y = rng.integers(0, 3, 300)
    small = spark.createDataFrame([(float(v), float(v) + 1.7e9, int(c)) for v, c in zip(x, y)], "a double, b double, y int")
    got = {r["feature"]: r["f_score"] for r in anova_f(small, ["a", "b"], "y").collect()}
    grand = x.mean()
    ssb = sum((y == c).sum() * (x[y == c].mean() - grand) ** 2 for c in range(3))
    ssw = sum(((x[y == c] - x[y == c].mean()) ** 2).sum() for c in range(3))
    assert got["a"] == pytest.approx((ssb / 2) / (ssw / 297)) and got["b"] == pytest.approx(got["a"], rel=1e-4)


def test_average_precision_leaves_out_missing_scores(spark):
    from flowlens.operators.evaluate import average_precision
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)]
    want = (1 + 2 / 3) / 2
    for extra in ([], [(0, None)] * 4, [(0, float("nan")), (None, 0.95)]):
        df = spark.createDataFrame(rows + extra, "y int, s double")
        assert average_precision(df, "y", "s").first()[0] == pytest.approx(want)


def test_quality_of_columns_with_nan(spark):
    from flowlens.operators.quality import near_zero_variance, outlier_percent
    from flowlens.operators.shape import clip_to_p99
    nan = float("nan")
    df = spark.createDataFrame([(1.0, float(i)) for i in range(97)] + [(nan, nan)] * 3, "c double, x double")
    assert {r["feature"]: r["near_zero"] for r in near_zero_variance(df, ["c", "x"]).collect()} == {"c": True, "x": False}
    assert {r["feature"]: r["outlier_pct"] for r in outlier_percent(df, ["c", "x"]).collect()} == {"c": 0.0, "x": 0.0}
    assert clip_to_p99(df, "x").count() == 96  # of 0..96 the 99th percentile is 95.04


def test_triage_never_allows_what_it_cannot_judge(spark):
    from flowlens.operators.score import triage
    rows = [("BENIGN", 0.9, 0.1), (None, 0.9, 0.1), ("BENIGN", None, 0.1), ("BENIGN", 0.9, None), ("DDoS", float("nan"), 0.9)]
    out = triage(spark.createDataFrame(rows, "p string, c double, s double"), "p", "c", "s").collect()
    assert [r["action"] for r in out] == ["ALLOW"] + ["QUARANTINE_FOR_ANALYSIS"] * 4
    assert [r["is_alert"] for r in out] == [False] + [True] * 4 and out[1]["classification"] == "UNSCORABLE"
