"""Multiclass gradient boosting (MOD-06): K regression trees a round on softmax residuals.

Rows are binned, and rows of equal bins and label, whose scores are always equal, become one row with their number. Rows carry
their K scores and stay where they are; a level of all K trees of a round is one scan. Tasks
send histograms - sums of residuals by class, node, feature and bin - which are added in Spark; splits are
chosen from them on the driver (their size is classes x nodes x features x bins, whatever the rows).
Trees are plain arrays, so scoring is one expression a class and needs no model object on executors.
"""
from __future__ import annotations

import json
import math
import sys
from dataclasses import asdict, dataclass, field
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, finite
from ..session import cut_lineage
from .ranking import quantiles

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

MAX_BINS = 64
FANIN = 64        # sums of tasks that the driver adds
MOST_NODES = 500  # nodes of a model that is scored by expressions


@dataclass
class Tree:
    """Node i: rows with feature <= threshold go to 2i + 1, others to 2i + 2; feature -1 is a leaf."""

    feature: list[int]
    threshold: list[float]
    value: list[float]


@dataclass
class BoostedTrees:
    features: list[str]
    classes: list[str]
    start: list[float]              # log shares of the classes
    rate: float
    rounds: list[list[Tree]] = field(default_factory=list)  # one tree a class in each round
    losses: list[float] = field(default_factory=list)       # mean log loss on the training rows before each round, and after the last

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> BoostedTrees:
        d = json.loads(text)
        d["rounds"] = [[Tree(**t) for t in trees] for trees in d["rounds"]]
        return BoostedTrees(**d)

    def _walk(self, tree: Tree, node: int = 0) -> Column:
        if tree.feature[node] < 0:
            return F.lit(float(tree.value[node]))
        x = F.coalesce(finite(col(self.features[tree.feature[node]])), F.lit(0.0))
        return F.when(x <= F.lit(tree.threshold[node]), self._walk(tree, 2 * node + 1)).otherwise(self._walk(tree, 2 * node + 2))

    def size(self) -> int:
        """Nodes of all trees."""
        return sum(1 + 2 * sum(f >= 0 for f in t.feature) for trees in self.rounds for t in trees)

    def scores(self, most_nodes: int = MOST_NODES) -> Column:
        """Array of raw scores, one a class: CASE expressions for a small model, else a function over Arrow batches.

        Generated code of a large model would pass the JVM's limit for a method and run uncompiled."""
        if self.size() > most_nodes:
            return self._batch_scores()
        totals = []
        for k in range(len(self.classes)):
            trees = [self._walk(r[k]) for r in self.rounds]
            total = F.aggregate(F.array(*trees), F.lit(0.0), lambda a, x: a + x) * F.lit(self.rate) if trees else F.lit(0.0)
            totals.append(F.lit(self.start[k]) + total)
        return F.array(*totals)

    def _batch_scores(self) -> Column:
        model = self

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            values = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(model.features)))
            scores = np.zeros((len(values), len(model.classes)))
            for trees in model.rounds:
                scores += np.column_stack([np.array(t.value)[_walk_values(t, values)] for t in trees])
            return pd.Series(list(np.asarray(model.start) + model.rate * scores))

        return run(F.array(*[F.coalesce(finite(col(f)), F.lit(0.0)) for f in self.features]))

    def predict(self, df: DataFrame, prediction: str = "prediction", probability: str = "probability", most_nodes: int = MOST_NODES) -> DataFrame:
        """Adds the class of the highest score (the first of equals) and the softmax of the scores."""
        scored = df.withColumn("__s", self.scores(most_nodes))
        shifted = F.transform("__s", lambda s: F.exp(s - F.array_max("__s")))
        scored = scored.withColumn("__e", shifted)
        total = F.aggregate("__e", F.lit(0.0), lambda a, x: a + x)
        names = F.array(*[F.lit(c) for c in self.classes])
        best = F.element_at(names, F.array_position("__s", F.array_max("__s")).cast("int"))
        return scored.withColumn(prediction, best).withColumn(probability, F.transform("__e", lambda e: e / total)).drop("__s", "__e")


def bin_edges(df: DataFrame, features: Sequence[str], max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Thresholds of each feature: midpoints of its distinct values if they are few, else of its quantiles."""
    qs = quantiles(df, features, [i / max_bins for i in range(max_bins + 1)], method="approx")  # any thresholds will do
    found: dict[str, set[float]] = {f: set() for f in features}
    for row in qs.collect():
        found[row["feature"]].add(row["q"])
    counts = df.agg(*[F.approx_count_distinct(col(f), 0.02).alias(f) for f in features]).first()
    few = [f for f in features if counts[f] <= max_bins // 2]
    for f in few:
        found[f] = {r[0] for r in df.select(col(f)).distinct().limit(max_bins + 1).collect()}
    return [np.array([(a + b) / 2 for a, b in zip(v, v[1:])]) for v in (sorted(found[f]) for f in features)]


def _leaf(total, weight, n_classes):
    """The Newton step of multinomial deviance: (K - 1) / K * sum r / sum |r| (1 - |r|)."""
    return 0.0 if weight < 1e-150 else (n_classes - 1) / n_classes * total / weight


def choose_splits(hist: np.ndarray, n_classes: int, last: bool, edges: list[np.ndarray], least: int, tree: Tree, nodes: list[int]) -> list[int]:
    """Splits of the nodes of one tree from hist[node, feature, bin, (count, residual, weight)]; returns the nodes opened.

    The split of greatest n_l n_r / (n_l + n_r) (mean_l - mean_r)^2 wins, the first feature and threshold among equals."""
    opened = []
    for at, node in enumerate(nodes):
        h = hist[at]
        count, total, weight = h[0].sum(axis=0)
        best = (0.0, -1, 0)
        if not last and count >= 2 * least:
            for f, cuts in enumerate(edges):
                left = np.cumsum(h[f, :len(cuts), :2], axis=0) if len(cuts) else np.zeros((0, 2))
                n_l, s_l = left[:, 0], left[:, 1]
                n_r, s_r = count - n_l, total - s_l
                ok = (n_l >= least) & (n_r >= least)
                if ok.any():
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(ok, n_l * n_r / count * (s_l / n_l - s_r / n_r) ** 2, -1.0)
                    b = int(np.argmax(gain))
                    if gain[b] > best[0] * (1 + 1e-9) + 1e-12:
                        best = (float(gain[b]), f, b)
        if best[1] < 0:
            tree.value[node] = _leaf(total, weight, n_classes)
        else:
            tree.feature[node], tree.threshold[node] = best[1], float(edges[best[1]][best[2]])
            opened += [2 * node + 1, 2 * node + 2]
    return opened


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _descend(tree: Tree, bins: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Node of each row in a tree that is grown so far."""
    node = np.zeros(len(bins), np.int64)
    feature, threshold = np.array(tree.feature), np.array(tree.threshold)
    while True:
        f = feature[node]
        moving = np.flatnonzero(f >= 0)
        if not len(moving):
            return node
        cut = np.array([np.searchsorted(edges[a], b) if a >= 0 else 0 for a, b in zip(feature, threshold)])
        right = bins[moving, f[moving]] > cut[node[moving]]
        node[moving] = 2 * node[moving] + 1 + right


def _walk_values(tree: Tree, values: np.ndarray) -> np.ndarray:
    """Leaf of each row of feature values."""
    feature, threshold = np.array(tree.feature), np.array(tree.threshold)
    node = np.zeros(len(values), np.int64)
    while True:
        moving = np.flatnonzero(feature[node] >= 0)
        if not len(moving):
            return node
        at = node[moving]
        node[moving] = 2 * at + 1 + (values[moving, feature[at]] > threshold[at])


def _columns(batch, n_features):
    bins = np.asarray(batch.column(0).flatten()).reshape(-1, n_features)
    scores = np.asarray(batch.column(1).flatten(), np.float64)
    y = np.asarray(batch.column(2))
    return bins, scores.reshape(len(y), -1), y, np.asarray(batch.column(3), np.float64)


def _histograms(trees, frontier, edges, n_classes, n_bins):
    """Rows -> sums by (class, node of the frontier, feature, bin), one row of matrices a task."""
    sizes = [len(n) for n in frontier]
    offsets = np.append(0, np.cumsum(sizes))

    def run(batches):
        total = np.zeros((int(offsets[-1]), len(edges), n_bins, 3))
        loss, rows = 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, scores, y, n = _columns(batch, len(edges))
            p = _softmax(scores)
            loss -= float((n * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum())
            rows += n.sum()
            for k in range(n_classes):
                if not frontier[k]:
                    continue
                residual = (y == k) - p[:, k]
                weight = np.abs(residual) * (1 - np.abs(residual))
                place = np.full(len(trees[k].feature), -1)
                place[frontier[k]] = np.arange(sizes[k])
                at = place[_descend(trees[k], bins, edges)]
                live = np.flatnonzero(at >= 0)
                for f in range(len(edges)):
                    key = at[live] * n_bins + bins[live, f]
                    for c, v in enumerate((n[live], n[live] * residual[live], n[live] * weight[live])):
                        total[offsets[k]:offsets[k + 1], f, :, c] += np.bincount(key, v, sizes[k] * n_bins).reshape(sizes[k], n_bins)
        yield pa.RecordBatch.from_arrays([pa.array([np.append(total.reshape(-1), [loss, rows]).tobytes()], pa.binary())], names=["sums"])
    return run


def _apply(trees, edges, rate, n_features):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, scores, _, _ = _columns(batch, n_features)
            step = np.column_stack([np.array(t.value)[_descend(t, bins, edges)] for t in trees])
            flat = (scores + rate * step).reshape(-1)
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, scores.shape[1], dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2), batch.column(3)], names=["bins", "scores", "y", "n"])
    return run


ROW_SCHEMA = "bins array<int>, scores array<double>, y int, n bigint"


def fit_boosting(df: DataFrame, features: Sequence[str], label: str, rounds: int = 50, depth: int = 5, rate: float = 0.1,
                 least: int = 1, max_bins: int = MAX_BINS, keep_scores: int = 10) -> BoostedTrees:
    """MOD-06: gradient boosting with ``rounds`` rounds of one depth-limited tree per class.

    NULL, NaN and infinite feature values count as 0 (as in the other models); rows without a label are left out. Rows
    are binned once and written, equal ones once with their number; every ``keep_scores`` rounds their scores are written too, which bounds both lineage and the
    trees that a task walks again. A table without labelled rows raises ValueError; one class gives trees of zeros."""
    fs = list(features)
    clean = df.select(*[F.coalesce(finite(col(f)), F.lit(0.0)).alias(f) for f in fs], col(label).cast("string").alias("__y")).where(F.col("__y").isNotNull())
    counts = {r["__y"]: r["n"] for r in clean.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a class
    if not counts:
        raise ValueError("boosting needs rows with a label")
    classes = sorted(counts)
    n = sum(counts.values())
    edges = bin_edges(clean, fs, max_bins)
    n_bins = max(len(e) for e in edges) + 1
    literal = lambda e: F.array(*[F.lit(float(x)) for x in e]) if len(e) else F.array().cast("array<double>")
    # a value's bin is the number of thresholds below it
    below = lambda f, e: F.size(F.filter(literal(e), lambda t: t < col(f)))
    bins = F.array(*[below(f, e) for f, e in zip(fs, edges)])
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("__y")).cast("int") - 1
    model = BoostedTrees(fs, classes, [math.log(counts[c] / n) for c in classes], rate)
    start = F.array(*[F.lit(s) for s in model.start])
    binned = clean.select(bins.alias("bins"), code.alias("y")).groupBy("bins", "y").agg(F.count(F.lit(1)).alias("n"))
    rows = cut_lineage(binned.select("bins", start.alias("scores"), "y", "n"))
    tasks = rows.rdd.getNumPartitions()  # of a checkpoint: no job
    since: list[list[Tree]] = []  # rounds that the written scores do not hold yet

    def catch_up(trees_of_rounds):
        def run(batches):
            for trees in trees_of_rounds:
                batches = _apply(trees, edges, rate, len(fs))(batches)
            return batches
        return run

    for _ in range(rounds):
        current = rows.mapInArrow(catch_up(list(since)), ROW_SCHEMA) if since else rows
        trees = [Tree([-1] * (2 ** (depth + 1) - 1), [0.0] * (2 ** (depth + 1) - 1), [0.0] * (2 ** (depth + 1) - 1)) for _ in classes]
        frontier = [[0] for _ in classes]
        for level in range(depth + 1):
            if not any(frontier):
                break
            parts = current.mapInArrow(_histograms(trees, frontier, edges, len(classes), n_bins), "sums binary")
            width = sum(map(len, frontier)) * len(fs) * n_bins * 3
            sums = _added(parts, width + 2, tasks)
            hist = sums[:-2].reshape(-1, len(fs), n_bins, 3)
            if level == 0:
                model.losses.append(float(sums[-2] / sums[-1]))
            at = 0
            for k in range(len(classes)):
                size = len(frontier[k])
                frontier[k] = choose_splits(hist[at:at + size], len(classes), level == depth, edges, least, trees[k], frontier[k])
                at += size
        model.rounds.append(trees)
        since.append(trees)
        if len(since) == keep_scores:
            rows, since = cut_lineage(rows.mapInArrow(catch_up(list(since)), ROW_SCHEMA)), []
    current = rows.mapInArrow(catch_up(list(since)), ROW_SCHEMA) if since else rows
    sums = _added(current.mapInArrow(_histograms([], [[] for _ in classes], edges, len(classes), n_bins), "sums binary"), 2, tasks)
    model.losses.append(float(sums[-2] / sums[-1]))
    return model


def _add_up(width):
    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])
    return run


def _added(parts: DataFrame, width: int, tasks: int) -> np.ndarray:
    """Sums of all tasks; those of many tasks are added in up to 32 tasks first."""
    if tasks > FANIN:
        parts = parts.repartition(min(32, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(_add_up(width), "sums binary")
    rows = parts.collect()  # at most FANIN rows
    return sum((np.frombuffer(r["sums"], np.float64) for r in rows), np.zeros(width))
