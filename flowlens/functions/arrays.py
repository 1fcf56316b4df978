"""Array-valued column expressions: probabilities, reconstruction error, similarity.

All are higher-order built-ins (transform / aggregate / zip_with), so they stay in
whole-stage codegen; no Python runs per row.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column) -> Column:
    """Softmax as one expression (fine for literal or cheap arrays; see with_softmax)."""
    m = F.array_max(logits)
    ex = F.transform(logits, lambda x: F.exp(x - m))
    s = array_sum(ex)
    return F.transform(ex, lambda x: x / s)


def with_softmax(df, logits: Column, out: str):
    """Softmax with every intermediate materialised as its own column.

    Composing the expression inline re-evaluates the logits (and anything they
    parse) inside each lambda call; separate projections are not re-inlined by
    the optimizer for non-cheap expressions, so each step runs once per row.
    """
    return (df.withColumn("__lg", logits)
              .withColumn("__mx", F.array_max("__lg"))
              .withColumn("__ex", F.transform("__lg", lambda x: F.exp(x - F.col("__mx"))))
              .withColumn("__sm", array_sum(F.col("__ex")))
              .withColumn(out, F.transform("__ex", lambda x: x / F.col("__sm")))
              .drop("__lg", "__mx", "__ex", "__sm"))


def argmax(a: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def normalized_entropy(p: Column, digits: int = 4) -> Column:
    """Shannon entropy of a probability vector divided by ln(k); p clipped to [1e-12, 1]."""
    clipped = F.transform(p, lambda x: F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0)))
    raw = -F.aggregate(clipped, F.lit(0.0), lambda acc, x: acc + x * F.ln(x))
    k = F.size(p)
    denom = F.when(k > 1, F.ln(k.cast("double"))).otherwise(F.lit(1.0))
    return F.round(raw / denom, digits)


def squared_error_sum(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def mse(a: Column, b: Column) -> Column:
    """Per-row mean squared error between two equal-length arrays."""
    return squared_error_sum(a, b) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(array_sum(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine similarity with the denominator floored at eps (each norm)."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def clip_array(a: Column, lo: float, hi: float) -> Column:
    return F.transform(a, lambda x: F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
