"""Derived CSV files are written by the tasks that read the rows: no task holds a flag or the whole table."""
from __future__ import annotations

import pytest

from flowlens import config as C
from flowlens.operators import quality as VAL
from flowlens.plans import catalog_misc as M
from flowlens.plans.all import ORACLE, QUERIES
from flowlens.plans.oracle_check import compare, duck
from flowlens.sources.csv import list_files

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("parts"))
    for name in ("lineitem", "orders", "customer"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").repartition(4).write.parquet(f"{d}/{name}.parquet")
    return d


def test_tasks_write_their_own_files_of_each_flag(spark, parts, monkeypatch):
    monkeypatch.setattr(M, "table", lambda s, d, name: s.read.parquet(f"{d}/{name}.parquet").repartition(4))
    assert list_files(spark, M._lineitem_folder(spark, parts), "*.csv").count() == 12
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    for name in ("folder_ingest", "file_inventory", "file_audit", "manifest_verify", "ingest_validation"):
        assert compare(QUERIES[name](spark, parts).toPandas(), duck(SF_SMALL).execute(ORACLE[name]).df())["hash_match"], name


def test_upload_of_part_files(spark, tmp_dir):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    li.repartition(3).write.option("header", "true").csv(tmp_dir + "/up.csv")
    configs = {"lineitem": C.LINEITEM_FLOWS, "events": C.EVENTS_FLOWS}
    s = VAL.ingest_validation(spark, tmp_dir + "/up.csv", configs)[0].first()
    assert (s.dataset_type, s.rows_checked, s.is_valid) == ("lineitem", li.count(), True)
    li.limit(3).select("l_tax").write.mode("append").option("header", "true").csv(tmp_dir + "/up.csv")
    with pytest.raises(ValueError):
        VAL.ingest_validation(spark, tmp_dir + "/up.csv", configs)
