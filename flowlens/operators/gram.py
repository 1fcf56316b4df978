"""Sums of products of all pairs of features in one scan, and what follows from them: correlations and principal axes.

Each task adds up d x d matrices of its rows (NULLs masked) with matrix products; tasks' matrices are
added in Spark in two steps. What reaches the driver is four d x d matrices, bounded by the schema.
"""
from __future__ import annotations

import sys
from typing import NamedTuple, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, finite

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

FANIN = 64  # matrices of tasks that are added in one task of the second step


class Gram(NamedTuple):
    """n[i, j]: rows where both are present; s[i, j], ss[i, j]: sums of x_i and x_i^2 over them; p[i, j]: sums of x_i x_j.

    Sums are of values less ``shift``, which keeps them from cancelling."""

    shift: np.ndarray
    n: np.ndarray
    s: np.ndarray
    ss: np.ndarray
    p: np.ndarray

    def covariance(self) -> np.ndarray:
        """Population covariance over the rows that both features have (NaN where there is none)."""
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = self.s / self.n
            return self.p / self.n - mean * mean.T

    def mean(self) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.shift + np.diag(self.s) / np.diag(self.n)

    def correlation(self) -> np.ndarray:
        """Pearson r over the rows that both features have; NaN if one is constant there."""
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = self.s / self.n
            var = self.ss / self.n - mean * mean
            # a spread below 1e-10 of the values' size is rounding, not variance
            size = np.abs(self.shift)[:, None] + np.sqrt(self.ss / self.n)
            var = np.where(var <= (1e-10 * size) ** 2, np.nan, var)
            return self.covariance() / np.sqrt(var * var.T)


def _partial(width: int):
    def run(batches):
        total = np.zeros((4, width, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in batch.columns[:-1]]) if batch.num_columns > 1 else None
            if rows is None or not width:
                continue
            there = ~np.isnan(rows)
            x, m = np.where(there, rows, 0.0), there.astype(np.float64)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])
    return run


def _partial_vectors(width: int, shift: np.ndarray):
    def run(batches):
        total = np.zeros((4, width, width))
        for batch in batches:
            column = batch.column(0)
            flat = column.flatten()
            rows = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, width) - shift
            rows = rows[np.isfinite(rows).all(axis=1)]
            ones = np.ones_like(rows)
            total += np.stack([ones.T @ ones, rows.T @ ones, (rows * rows).T @ ones, rows.T @ rows])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])
    return run


def _add(width: int):
    def run(batches):
        total = np.zeros(4 * width * width)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])
    return run


def _summed(parts: DataFrame, width: int) -> np.ndarray:
    """Matrices of all tasks -> their sum; at most FANIN of them reach the driver."""
    rows = parts.repartition(FANIN).mapInArrow(_add(width), "sums binary").collect()
    return sum((np.frombuffer(r["sums"], np.float64) for r in rows), np.zeros(4 * width * width)).reshape(4, width, width)


def gram(df: DataFrame, features: Sequence[str]) -> Gram:
    """Masked sums of all pairs of ``features`` (NULL, NaN and infinite values are absent) in one scan."""
    fs = list(features)
    clean = df.select(*[finite(col(f)).alias(f"x{i}") for i, f in enumerate(fs)])
    # any shift gives the same result but for rounding; the means of some rows are near enough
    some = clean.limit(1000).agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(len(fs))]).first()
    shift = np.array([some[f"x{i}"] or 0.0 for i in range(len(fs))])
    moved = clean.select(*[(F.col(f"x{i}") - F.lit(float(shift[i]))).alias(f"x{i}") for i in range(len(fs))], F.lit(1).cast("byte").alias("row"))
    sums = _summed(moved.mapInArrow(_partial(len(fs)), "sums binary"), len(fs))
    return Gram(shift, *sums)


def vector_gram(df: DataFrame, vec: str, width: int) -> Gram:
    """``gram`` of the components of an array column; rows of another length or with a missing component are left out."""
    v = col(vec).cast("array<double>")
    rows = df.select(v.alias("v")).where((F.size("v") == width) & ~F.exists("v", lambda x: x.isNull()))
    some = rows.limit(1000).select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).collect()  # one row a component
    shift = np.zeros(width)
    for r in some:
        shift[r["i"]] = r["x"] if np.isfinite(r["x"]) else 0.0
    return Gram(shift, *_summed(rows.mapInArrow(_partial_vectors(width, shift), "sums binary"), width))


class PrincipalAxes(NamedTuple):
    """A linear reconstructor: the mean and the ``k`` orthonormal axes of largest variance."""

    mean: np.ndarray
    axes: np.ndarray  # k x d
    variances: np.ndarray

    def to_df(self, spark) -> DataFrame:
        rows = [(-1, None, self.mean.tolist())] + [(i, float(v), a.tolist()) for i, (v, a) in enumerate(zip(self.variances, self.axes))]
        return spark.createDataFrame(rows, "axis int, variance double, components array<double>")

    @staticmethod
    def from_df(df: DataFrame) -> PrincipalAxes:
        rows = sorted(df.collect(), key=lambda r: r["axis"])  # one row an axis
        return PrincipalAxes(np.array(rows[0]["components"]), np.array([r["components"] for r in rows[1:]]), np.array([r["variance"] for r in rows[1:]]))


def fit_axes(df: DataFrame, vec: str, k: int, width: int | None = None) -> PrincipalAxes:
    """SCR-04: principal axes of (benign) rows: Gram matrix by tasks, eigenvectors of the d x d matrix on the driver.

    The sign of an axis is fixed by its largest component. Fewer than two usable rows raise ValueError."""
    if width is None:
        width = df.select(F.max(F.size(col(vec))).alias("w")).first()["w"] or 0
    g = vector_gram(df, vec, width)
    if not width or g.n[0, 0] < 2:
        raise ValueError("principal axes need at least two rows without missing components")
    values, vectors = np.linalg.eigh(g.covariance())
    best = np.argsort(-values, kind="stable")[:k]
    axes = vectors[:, best].T
    signs = np.sign(axes[np.arange(len(axes)), np.argmax(np.abs(axes), axis=1)])
    return PrincipalAxes(g.mean(), axes * signs[:, None], np.maximum(values[best], 0.0))


def axes_error(vec: Column, fitted: PrincipalAxes) -> Column:
    """SCR-04: mean squared error between a vector and its reconstruction from the axes, as one expression.

    For orthonormal axes it is (|x - m|^2 - sum (a . (x - m))^2) / d; rows without the vector give NULL."""
    literal = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    centred = F.zip_with(vec.cast("array<double>"), literal(fitted.mean), lambda x, m: x - m)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)

    def error(c: Column) -> Column:
        kept = [F.pow(total(F.zip_with(c, literal(a), lambda x, y: x * y)), 2) for a in fitted.axes]
        explained = kept[0] if kept else F.lit(0.0)
        for part in kept[1:]:
            explained = explained + part
        left = total(F.transform(c, lambda x: x * x)) - explained
        return F.when(left < 0, 0.0).otherwise(left) / float(len(fitted.mean))  # NULL stays NULL

    return F.element_at(F.transform(F.array(centred), error), 1)
