"""Keyed pairing, neighbours across tasks, Gram sums and principal axes against brute force."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import gram as GR
from flowlens.operators import neighbors as NB
from flowlens.operators import pairing as PA
from flowlens.operators import stats as AGG


def test_pairs_by_key_without_a_shuffle(spark):
    truth = [(1, "a", "N"), (2, "a", "R"), (2, "a", "R"), (3, "b", "N"), (4, None, "R"), (5, "c", "A"), (6, "d", "A"), (6, "d", "N")]
    pred = [(1, "a", "N"), (2, "a", "N"), (4, None, "R"), (5, "c", "A"), (5, "c", "R"), (6, "d", "N"), (6, "d", "N"), (7, "e", "N")]
    t = PA.write_keyed(spark.createDataFrame(truth, "k int, s string, label string"), ["k", "s"], buckets=4)
    p = PA.write_keyed(spark.createDataFrame(pred, "k int, s string, guess string"), ["k", "s"], buckets=4)
    pairs = PA.pair_predictions(t, p, ["k", "s"], "label", "guess")
    got = sorted(((r.k, r.n_truth, r.n_prediction, r.truth, r.prediction, r.state) for r in pairs.collect()), key=str)
    assert got == sorted([
        (1, 1, 1, "N", "N", "paired"), (2, 2, 1, None, "N", "repeated_truth"), (3, 1, 0, "N", None, "only_truth"),
        (4, 1, 0, "R", None, "only_truth"), (4, 0, 1, None, "R", "only_prediction"), (5, 1, 2, "A", None, "repeated_prediction"),
        (6, 2, 2, None, None, "repeated_both"), (7, 0, 1, None, "N", "only_prediction")], key=str)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    report = {r.state: (r["keys"], r.truth_rows, r.prediction_rows) for r in PA.pairing_report(pairs).collect()}
    assert report["paired"] == (1, 1, 1) and report["repeated_both"] == (1, 2, 2) and report["only_truth"] == (2, 2, 0) and len(report) == 6
    assert not [x.name for x in spark.catalog.listTables() if x.name.startswith("keyed_")]
    assert PA.pair_predictions(t.limit(0), p, ["k", "s"], "label", "guess").where("state <> 'only_prediction' and state <> 'repeated_prediction'").count() == 0


@pytest.mark.parametrize("k,parts", [(1, 1), (2, 7), (3, 40)])
def test_neighbours_cross_task_borders(spark, k, parts):
    rng = random.Random(k)
    rows = {(g, rng.randrange(500)) for g in "abc" for _ in range(60 if g == "a" else 9)} | {("z", 3)}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges of a few rows each
    try:
        df = spark.createDataFrame([(g, v, f"{g}{v}") for g, v in rows], "g string, v long, name string")
        got = {(r.g, r.v): ([x["name"] for x in r.before], [x["name"] for x in r.after]) for r in NB.neighbours(df, ["g"], "v", k, ["name"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for g in "abcz":
        vs = sorted(v for x, v in rows if x == g)
        for i, v in enumerate(vs):
            want[g, v] = ([f"{g}{x}" for x in vs[max(0, i - k):i]], [f"{g}{x}" for x in vs[i + 1:i + 1 + k]])
    assert got == want


def psi(x):
    s = sum(1 / (x + i) for i in range(20))
    y = x + 20
    return math.log(y) - 0.5 / y - 1 / (12 * y * y) + 1 / (120 * y ** 4) - s


def information_by_hand(xs, ys, k):
    rows = [(x, y) for x, y in zip(xs, ys) if y is not None and x is not None and math.isfinite(x)]
    size = {y: sum(1 for _, b in rows if b == y) for _, y in rows}
    rows = [(x, y) for x, y in rows if size[y] > 1]
    terms = []
    for i, (x, y) in enumerate(rows):
        use = min(k, size[y] - 1)
        r = sorted(abs(x - a) for j, (a, b) in enumerate(rows) if b == y and j != i)[use - 1]
        m = sum(1 for a, _ in rows if abs(a - x) < r or a == x)
        terms.append((psi(use), psi(size[y]), psi(m)))
    n = len(rows)
    return max(0.0, psi(n) + sum(a - b - c for a, b, c in terms) / n)


def test_information_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(260):
        y = rng.choice("aaabbc")
        rows.append((float(rng.randrange(40)) / 8, rng.randrange(-1000, 1000) / 4 + (300 if y == "b" else 0), 7.5, y))
    rows += [(1.0, 2.0, 7.5, "single"), (None, 3.0, 7.5, "pair"), (2.0, float("inf"), 7.5, "pair"), (3.0, 1.0, 7.5, None), (9.0, float("nan"), 7.5, "a"), (4.0, -77.0, 7.5, "pair")]
    df = spark.createDataFrame(rows, "x double, z double, same double, y string").repartition(5)
    got = {r.feature: r.mutual_info for r in NB.neighbour_mutual_information(df, ["x", "z", "same"], "y", 3).collect()}
    for i, f in enumerate(("x", "z", "same")):
        assert got[f] == pytest.approx(information_by_hand([r[i] for r in rows], [r[3] for r in rows], 3), abs=1e-9)
    assert got["z"] > got["same"]


def test_digamma(spark):
    got = spark.range(1, 200).select("id", NB.digamma(F.col("id").cast("double")).alias("p")).collect()
    assert max(abs(r.p - psi(r.id)) for r in got) < 1e-10


def test_correlations_of_masked_pairs(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 4)) * [1, 1e-3, 1e4, 1] + [0, 1e6, -1e7, 3]
    x[:, 3] = 2 * x[:, 0] + 1e3
    x[rng.random(x.shape) < 0.1] = np.nan
    names = ["a", "b", "c", "d"]
    rows = [(*[None if i % 7 == 0 and math.isnan(v) else float(v) for v in r], 5.1) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", `con.stant` double").repartition(6)
    got = {(r.feature_a, r.feature_b): r.r for r in AGG.correlation_pairs(df, [*names, "con.stant"]).collect()}
    assert len(got) == 10
    for i, a in enumerate(names):
        assert got[a, "con.stant"] is None
        for j in range(i + 1, 4):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert got[a, names[j]] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-6)
    assert AGG.correlation_pairs(df.limit(0), names).where("r is not null").count() == 0


def test_axes_equal_a_dense_decomposition(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 3)) @ rng.standard_normal((3, 8)) + 0.1 * rng.standard_normal((300, 8)) + 50
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows + [(900, None), (901, [1.0]), (902, [None] * 8), (903, [float("nan")] * 8)], "id int, v array<double>").repartition(5)
    fitted = GR.fit_axes(df, "v", 3, 8)
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(fitted.mean, x.mean(axis=0)) and np.allclose(fitted.variances, s[:3] ** 2 / 300)
    assert np.allclose(np.abs(fitted.axes @ vt[:3].T), np.eye(3), atol=1e-6)
    want = ((centred - centred @ vt[:3].T @ vt[:3]) ** 2).mean(axis=1)
    again = GR.PrincipalAxes.from_df(fitted.to_df(spark))
    got = {r.id: r.e for r in df.select("id", GR.axes_error(F.col("v"), again).alias("e")).collect()}
    assert np.allclose([got[i] for i in range(300)], want, atol=1e-8) and got[900] is None
    with pytest.raises(ValueError):
        GR.fit_axes(df.limit(0), "v", 2, 8)
