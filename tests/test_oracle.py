"""Every registered query against its DuckDB oracle on the smallest driver tables, plus
the driver contract (entry / queries / oracle_sql)."""
from __future__ import annotations

import os

import pytest

from flowlens.plans.all import ORACLE, QUERIES
from flowlens.plans.oracle_check import compare, duck

from .conftest import SF_SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")

SLOW = {"model_comparison", "extended_models"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL).toPandas()
    ddf = con.execute(ORACLE[name]).df()
    res = compare(sdf, ddf)
    assert res["columns_match"], res
    assert res["spark_rows"] == res["oracle_rows"], res
    assert res["hash_match"], res


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() >= 1


def test_driver_contract(spark):
    import importlib.util
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(root, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    out = mod.entry(spark)
    assert out.count() >= 1
    assert set(mod.oracle_sql()) <= set(mod.queries())
    assert len(mod.queries()) >= 90
