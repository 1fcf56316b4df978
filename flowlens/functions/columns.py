"""Column-expression helpers shared by all operators (JVM-side built-ins only)."""
from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)
FRACTIONAL_TYPES = (T.FloatType, T.DoubleType)


def q(name: str) -> str:
    """Back-quote a column name (names may contain spaces, slashes, dots)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in ex]


def fractional(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, FRACTIONAL_TYPES)


def is_inf(c: Column) -> Column:
    return (c == F.lit(float("inf"))) | (c == F.lit(float("-inf")))


def is_missing(c: Column, fractional_type: bool = True) -> Column:
    """NULL or NaN (pandas folds both into 'missing')."""
    return (c.isNull() | F.isnan(c)) if fractional_type else c.isNull()


def finite(c: Column) -> Column:
    """NaN and +-inf become NULL; every downstream operator assumes NULL-only."""
    return F.when(F.isnan(c) | is_inf(c), F.lit(None).cast("double")).otherwise(c.cast("double"))


def to_double(c: Column) -> Column:
    """Lenient numeric coercion: bad text becomes NULL (ANSI-safe)."""
    return c.try_cast("double")


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def one_if_zero(c: Column) -> Column:
    """Degenerate divisors (0 spread) become 1."""
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


def any_of(conds: Iterable[Column]) -> Column:
    conds = list(conds)
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def all_of(conds: Iterable[Column]) -> Column:
    conds = list(conds)
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def contains_any(name_col: Column, patterns: Iterable[str]) -> Column:
    """Case-insensitive substring test against a fixed pattern list."""
    low = F.lower(name_col)
    return any_of(F.instr(low, p.lower()) > 0 for p in patterns)


def hash_order(keys: Iterable[str], seed: int = 42) -> Column:
    """Deterministic pseudo-random order: md5('k1|k2:seed').

    Independent of partitioning and reproducible in any SQL engine with md5.
    """
    parts = [col(k).cast("string") for k in keys]
    return F.md5(F.concat(F.concat_ws("|", *parts), F.lit(f":{seed}")))


def row_hash(df: DataFrame, cols: Iterable[str] | None = None) -> Column:
    """64-bit hash of whole rows, used for streaming dedup keys."""
    cols = list(cols or df.columns)
    return F.xxhash64(*[col(c) for c in cols])


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every fractional column (report formatting)."""
    return df.select(*[F.round(col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, FRACTIONAL_TYPES) else col(f.name)
                       for f in df.schema.fields])


def grouped_values(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Columns whose hashes are equal where grouping finds them equal: -0.0 is 0.0 and all NaNs are one."""
    kinds = dict(df.dtypes)
    return [F.when(F.isnan(col(c)), F.lit(float("nan"))).otherwise(col(c) + F.lit(0.0)) if kinds[c] in ("double", "float") else col(c) for c in columns]


def row_hashes(df: DataFrame, columns: Sequence[str]) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row that tell NULLs apart, and take -0.0 for 0.0 and all NaNs for one, as grouping does."""
    value = grouped_values(df, columns)
    nulls = F.concat(F.lit(""), *[F.when(col(c).isNull(), "1").otherwise("0") for c in columns])
    return F.xxhash64(nulls, *value), F.xxhash64(F.lit("second"), *value, nulls)
