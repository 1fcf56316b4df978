"""Multiclass boosting against a plain version that tries every threshold."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import boosting as B


def grow(x, residual, weight, depth, k):
    """The regression tree of one class by trying every midpoint of every feature: a function of rows."""
    def node(rows, left):
        total, w = residual[rows].sum(), weight[rows].sum()
        best = (1e-12, None)
        for f in range(x.shape[1]) if left else ():
            v = np.unique(x[rows, f])
            for t in (v[1:] + v[:-1]) / 2:
                a, b = rows[x[rows, f] <= t], rows[x[rows, f] > t]
                gain = len(a) * len(b) / len(rows) * (residual[a].mean() - residual[b].mean()) ** 2
                if gain > best[0] * (1 + 1e-9) + 1e-12:
                    best = (gain, (f, t, a, b))
        if best[1] is None:
            out = 0.0 if w < 1e-150 else (k - 1) / k * total / w
            return lambda q: np.full(len(q), out)
        f, t, a, b = best[1]
        low, high = node(a, left - 1), node(b, left - 1)
        return lambda q: np.where(q[:, f] <= t, low(q), high(q))
    return node(np.arange(len(x)), depth)


def boost_by_hand(x, y, k, rounds, depth, rate):
    scores = np.tile(np.log(np.bincount(y, minlength=k) / len(y)), (len(y), 1))
    losses = []
    for r in range(rounds + 1):
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        losses.append(-np.log(p[np.arange(len(y)), y]).mean())
        if r == rounds:
            return scores, losses
        step = []
        for c in range(k):
            res = (y == c) - p[:, c]
            step.append(grow(x, res, np.abs(res) * (1 - np.abs(res)), depth, k)(x))
        scores = scores + rate * np.column_stack(step)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 9, 240), rng.integers(0, 12, 240) / 4, rng.integers(0, 3, 240)]).astype(float)
    y = ((x[:, 0] > 4).astype(int) + (x[:, 1] > 1.5) * (x[:, 2] < 2)).astype(int)
    y = np.where(rng.random(240) < 0.1, rng.integers(0, 3, 240), y)
    rows = [(*map(float, r), "abc"[c]) for r, c in zip(x, y)]
    return x, y, spark.createDataFrame(rows, "`f.0` double, g double, h double, cls string").repartition(5)


def test_equals_brute_force_and_loss_falls(table):
    x, y, df = table
    model = B.fit_boosting(df, ["f.0", "g", "h"], "cls", rounds=6, depth=2, rate=0.3, keep_scores=4)
    scores, losses = boost_by_hand(x, y, 3, 6, 2, 0.3)
    assert np.allclose(model.losses, losses, atol=1e-9)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:]))
    again = B.BoostedTrees.from_json(model.to_json())
    assert 20 < again.size() < B.MOST_NODES
    batches = {(r["f.0"], r.g, r.h): (r.prediction, r.probability) for r in again.predict(df, most_nodes=0).collect()}
    out = again.predict(df).collect()
    assert all(batches[r["f.0"], r.g, r.h][0] == r.prediction and np.allclose(batches[r["f.0"], r.g, r.h][1], r.probability) for r in out)
    for r in out:
        at = np.flatnonzero((x == [r["f.0"], r.g, r.h]).all(axis=1))[0]
        e = np.exp(scores[at] - scores[at].max())
        assert np.allclose(r.probability, e / e.sum(), atol=1e-9) and r.prediction == "abc"[int(np.argmax(scores[at]))]
    assert np.mean([r.prediction == r.cls for r in out]) > 0.8


def test_odd_tables(spark, table):
    _, _, df = table
    rows = [(None, 1.0, "a"), (float("nan"), 2.0, "b"), (float("inf"), 1.0, None), (3.0, 2.0, "b")]
    odd = spark.createDataFrame(rows, "f double, g double, cls string")
    model = B.fit_boosting(odd, ["f", "g"], "cls", rounds=2, depth=3)
    assert model.classes == ["a", "b"] and model.losses[2] < model.losses[0]
    assert [r.prediction for r in model.predict(odd).orderBy("g", "f").collect()].count("b") >= 2
    single = B.fit_boosting(df.where("cls = 'a'"), ["g"], "cls", rounds=1, depth=1)
    assert single.losses == [0.0, 0.0]
    with pytest.raises(ValueError):
        B.fit_boosting(df.limit(0), ["g"], "cls")


def test_rows_of_equal_bins_are_scanned_once(spark, monkeypatch):
    """Ten times the rows are the same model, and no more rows to scan."""
    scanned = []
    keep = B.cut_lineage
    monkeypatch.setattr(B, "cut_lineage", lambda df: scanned.append(keep(df)) or scanned[-1])
    df = spark.range(600).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
                                 F.when(F.col("id") % 35 < 12, "x").when(F.col("id") % 7 < 4, "y").otherwise("z").alias("c"))
    once = B.fit_boosting(df, ["a", "b"], "c", rounds=3, depth=2)
    often = B.fit_boosting(df.crossJoin(spark.range(10).select(F.col("id").alias("copy"))), ["a", "b"], "c", rounds=3, depth=2)
    assert np.allclose(once.losses, often.losses) and [[t.feature for t in r] for r in once.rounds] == [[t.feature for t in r] for r in often.rounds]
    assert [s.count() for s in scanned] == [35, 35] and [s.agg(F.sum("n")).first()[0] for s in scanned] == [600, 6000]
