"""Listings, headers, digests and first rows made in tasks; quantiles by rank selection; duplicates by row hashes."""
from __future__ import annotations

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions.columns import row_hashes
from flowlens.operators import quality as VAL
from flowlens.operators import ranking as R
from flowlens.sources import csv as CSV
from flowlens.sources import files as FI
from flowlens.sources import listing as LS


def put(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


@pytest.fixture()
def tree(tmp_dir):
    put(f"{tmp_dir}/t/a.csv", b"x,y\n1,2\n3,4\n")
    put(f"{tmp_dir}/t/deep/er/b c.csv", b"\xef\xbb\xbfx, y\r\n5,6\r\n")
    put(f"{tmp_dir}/t/deep/c.csv", b"y,z\n7,8\n9,10\n")
    put(f"{tmp_dir}/t/deep/empty.csv", b"")
    put(f"{tmp_dir}/t/deep/blank.csv", b"\n1,2\n")
    put(f"{tmp_dir}/t/other.txt", b"no\x00pe")
    return f"{tmp_dir}/t"


def test_listing_and_headers(spark, tree):
    found = {r.path.split("/t/")[1]: (r.length, r.modified is not None) for r in CSV.list_files(spark, tree, "*.csv").collect()}
    assert found == {"a.csv": (12, True), "deep/er/b c.csv": (14, True), "deep/c.csv": (13, True), "deep/empty.csv": (0, True), "deep/blank.csv": (5, True)}
    heads = {os.path.basename(r.path): r.header for r in CSV.file_headers(spark, CSV.list_files(spark, tree, "*.csv")).collect()}
    assert heads == {"a.csv": ["x", "y"], "b c.csv": ["x", "y"], "c.csv": ["y", "z"], "empty.csv": [], "blank.csv": []}
    df = CSV.load_folder(spark, tree, "d", numeric=["x", "y", "z"])
    assert sorted((r.Source_File, r.x, r.y, r.z) for r in df.collect() if r.x is not None) == [("a.csv", 1.0, 2.0, None), ("a.csv", 3.0, 4.0, None), ("b%20c.csv", 5.0, 6.0, None)] \
        or sorted((r.Source_File, r.x, r.y, r.z) for r in df.collect() if r.x is not None) == [("a.csv", 1.0, 2.0, None), ("a.csv", 3.0, 4.0, None), ("b c.csv", 5.0, 6.0, None)]
    assert df.where("z is not null").count() == 2
    with pytest.raises(FileNotFoundError):
        CSV.list_files(spark, tree + "/nothing")


def test_audit_manifest_inventory(spark, tree):
    audit = {os.path.basename(r.path): r.problem for r in FI.audit(spark, tree, max_bytes=13).collect()}
    assert audit == {"a.csv": None, "b c.csv": "file too large", "c.csv": None, "empty.csv": "empty file", "blank.csv": "blank header", "other.txt": "not a CSV file"}
    got = {r["name"]: (r.sha256, r.size_bytes) for r in FI.manifest(spark, tree).collect()}
    for name, at in (("a.csv", "a.csv"), ("empty.csv", "deep/empty.csv"), ("other.txt", "other.txt"), ("b c.csv", "deep/er/b c.csv")):
        data = open(f"{tree}/{at}", "rb").read()
        assert got[name] == (hashlib.sha256(data).hexdigest(), len(data))
    inv = {os.path.basename(r.path): (r.columns, r.last_column) for r in FI.inventory(spark, tree).collect()}
    assert inv["a.csv"] == (2, "y") and inv["c.csv"] == (2, "z") and inv["empty.csv"] == (0, None)


def test_digest_of_a_file_over_two_gigabytes(spark, tmp_dir):
    path = f"{tmp_dir}/big.bin"
    with open(path, "wb") as f:  # sparse: no disk is used
        f.truncate((2 << 30) + 5)
        f.seek(1 << 30)
        f.write(b"middle")
    want = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 24):
            want.update(part)
    row = FI.manifest(spark, tmp_dir, "*.bin").first()
    assert (row.sha256, row.size_bytes) == (want.hexdigest(), (2 << 30) + 5)
    head = LS.first_bytes(LS.list_tree(spark, tmp_dir, "*.bin"), 100).first().head
    assert bytes(head) == b"\0" * 100


@pytest.mark.parametrize("block", ["128m", "700b"])
def test_first_rows_are_the_first_lines(spark, tmp_dir, block):
    lines = {f: [f"{i},{f}{i}" for i in range(n)] for f, n in (("a", 400), ("b", 3), ("c", 50))}
    for f, rows in lines.items():
        put(f"{tmp_dir}/{f}.csv", ("k,v\n" + "\n".join([*rows[:1], "1,too,long", *rows[1:]]) + "\n").encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)  # many blocks a file
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        for n in (1, 20, 45, 1000):
            got = CSV.load_folder(spark, tmp_dir, "d", first_rows=n).groupBy("Source_File").agg(F.sort_array(F.collect_list(F.col("k").cast("int"))).alias("k")).collect()
            assert {r.Source_File: r.k for r in got} == {f"{f}.csv": list(range(min(n, len(rows)))) for f, rows in lines.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rank_selection_equals_sorting(spark):
    rng = np.random.default_rng(8)
    n = 5000
    cols = {"normal": rng.standard_normal(n), "ties": rng.integers(0, 3, n).astype(float), "same": np.full(n, 4.5), "skew": np.exp(3 * rng.standard_normal(n)),
            "holes": np.where(rng.random(n) < 0.7, np.nan, rng.standard_normal(n)), "zeros": np.where(rng.random(n) < 0.9, 0.0, rng.standard_normal(n))}
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in np.column_stack(list(cols.values()))]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in cols)).repartition(7).withColumn("none", F.lit(None).cast("double"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    for accuracy, most in ((2000, 200_000), (20, 100), (50, 1)):
        got = {(f, p): q for f, p, q in R.select_quantiles(df, [*cols, "none"], probs, accuracy, most)}
        assert len(got) == len(cols) * len(probs)
        for c, v in cols.items():
            assert np.allclose([got[c, p] for p in probs], np.quantile(v[~np.isnan(v)], probs), rtol=0, atol=1e-12), (c, accuracy)
    assert R.select_quantiles(df.limit(0), list(cols), probs) == []


def test_duplicates_by_hash_only_shuffle_hashes(spark):
    rows = [(1, "a", 0.0), (1, "a", -0.0), (1, None, float("nan")), (1, None, float("nan")), (None, "1", 1.0), (1, "", 1.0), (None, "1", 1.0), (1, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "k int, s string, x double").repartition(3)
    one = VAL.duplicate_counts(df).first()
    assert (one["rows"], one["duplicate_rows"]) == (9, 3)
    a, b = row_hashes(df, df.columns)
    assert df.select(a.alias("a"), b.alias("b")).distinct().count() == 6
    plan = VAL.duplicate_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a" in plan and "hashpartitioning(k" not in plan
    empty = VAL.duplicate_counts(df.limit(0)).first()
    assert (empty["rows"], empty["duplicate_rows"]) == (0, 0)
