"""Query registry shared by the catalog modules."""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators.ranking import quantiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

LF = C.LINEITEM_FLOWS
FEATS = list(LF.features)
# (orderkey, linenumber) repeats in the generated lineitem; with part and supplier it is unique
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def fin(x: str) -> str:
    """SQL twin of functions.columns.finite."""
    return f"(CASE WHEN isnan({x}) OR isinf({x}) THEN NULL ELSE {x} END)"


def r(c, d=6):
    """Round for comparison; '+ 0.0' turns a negative zero into zero."""
    return F.round(c if not isinstance(c, str) else F.col(c), d) + F.lit(0.0)


def _q(spark: SparkSession, df: DataFrame, p: float, column: str) -> float:
    return quantiles(df.select(F.col(column)), [column], [p]).first()["q"]


