"""CSV sources for flow datasets (SRC-01..11).

Files of one dataset may carry different headers; a single Spark CSV read maps
columns by position, so files are grouped by header first and each group is
read with its own header, then unioned by name. Listings and first lines are read in tasks
(sources/listing.py); the driver holds the paths of a header group, as a scan's own file index does.
"""
from __future__ import annotations

from collections import defaultdict
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DatasetConfig
from ..functions.text import first_path_segment
from ..operators import shape as SH
from . import listing as LS

EXTRA = "__extra_field"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def list_files(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """Recursive listing (path, length, modified), empty files included (file scans skip them).

    Folders are listed by tasks; only for a store that pyarrow cannot open, the driver asks Hadoop's FileSystem."""
    p, fs = _fs(spark, root)
    full = str(fs.makeQualified(p).toString())
    if not fs.exists(p):
        raise FileNotFoundError(root)
    if LS.readable(full):
        return LS.list_tree(spark, full, glob)
    import fnmatch
    it = fs.listFiles(p, True)
    rows = []
    while it.hasNext():
        st = it.next()
        path = str(st.getPath().toString())
        if fnmatch.fnmatch(path.rsplit("/", 1)[-1], glob):
            rows.append((path, int(st.getLen()), int(st.getModificationTime())))
    df = spark.createDataFrame(rows, "path string, length bigint, modified_ms bigint")
    return df.withColumn("modified", F.timestamp_millis("modified_ms")).drop("modified_ms")


def file_headers(spark: SparkSession, paths: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """path and header (array of names) of many files, read by tasks."""
    some = paths.select("path").first()
    if some is None or LS.readable(some["path"]):
        return LS.headers(paths, encoding)
    return spark.createDataFrame([(r["path"], read_header(spark, r["path"])) for r in paths.collect()], "path string, header array<string>")


def first_line(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str | None:
    """First line of one file through the cluster file system (metadata-sized read)."""
    jvm = spark._jvm
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, encoding))
        return reader.readLine()
    finally:
        stream.close()


def read_header(spark: SparkSession, path: str) -> list[str]:
    """SRC-09: column names only (no row scan), stripped."""
    line = first_line(spark, path)
    if line is None:
        return []
    import csv
    return [c.strip() for c in next(csv.reader([line]))]


def upload_header(spark: SparkSession, path: str) -> list[str]:
    """SRC-09: column names of a CSV file, or of a folder of part files; parts with different headers are an error."""
    p, fs = _fs(spark, path)
    if not fs.getFileStatus(p).isDirectory():
        return read_header(spark, path)
    parts = file_headers(spark, list_files(spark, path).where("length > 0"))
    found = parts.select("header").distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"the files of {path} have different headers")
    return list(found[0]["header"]) if found else []


def load_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             infer_schema: bool = False) -> DataFrame:
    """SRC-01: one CSV file; missing file or non-.csv path is an error; headers stripped."""
    if not path.lower().endswith(".csv"):
        raise ValueError(f"Not a CSV file: {path}")
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    r = spark.read.option("header", "true")
    if schema is not None:
        r = r.schema(schema)
    elif infer_schema:
        r = r.option("inferSchema", "true")
    return SH.strip_column_names(r.csv(path))


def _string_schema(cols: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in cols])


def read_group(spark: SparkSession, files: Sequence[str], header: Sequence[str], encoding: str = "UTF-8",
               skip_long_rows: bool = True, first_rows: int | None = None) -> DataFrame:
    """Read files sharing one header with an explicit all-string schema.

    Short rows are padded with NULL (kept); rows with more fields than the header
    are dropped (SRC-03 'skip bad lines'). Duplicate header names get positional
    suffixes. Adds ``__source_path``.
    """
    names, seen = [], defaultdict(int)
    for c in header:
        c = c.strip()
        seen[c] += 1
        names.append(c if seen[c] == 1 else f"{c}{seen[c] - 1}")
    # one sentinel column past the header: it is non-NULL exactly when a row carries more
    # fields than the header (short rows are padded with NULL and kept)
    schema = _string_schema(names).add(T.StructField(EXTRA, T.StringType(), True))
    df = (spark.read.option("header", "true").option("mode", "PERMISSIVE").option("encoding", encoding)
          .schema(schema).csv(list(files)))
    df = df.withColumn("__source_path", F.col("_metadata.file_path"))
    if first_rows is not None:
        # rows of a block are read in order; the id rises within a task
        df = df.withColumn("__block", F.col("_metadata.file_block_start")).withColumn("__line", F.monotonically_increasing_id())
    if skip_long_rows:
        df = df.where(F.col(EXTRA).isNull())
    df = df.drop(EXTRA)
    return df if first_rows is None else first_lines(df, first_rows)


def first_lines(df: DataFrame, n: int) -> DataFrame:
    """SRC-08: the first ``n`` rows of each file, in the order of its lines, from rows with __source_path, __block and __line.

    Rows are counted by block; whole blocks before the cut pass, blocks behind it go, and only the block that holds the cut is ranked, so no
    file is sorted or held by one task."""
    blocks = df.groupBy("__source_path", "__block").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy("__source_path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    left = blocks.withColumn("__left", F.lit(n) - F.coalesce(F.sum("__rows").over(before), F.lit(0))).where("__left > 0")
    near = df.join(left, ["__source_path", "__block"])
    own = [c for c in df.columns if c not in ("__block", "__line")]
    whole = near.where(F.col("__left") >= F.col("__rows"))
    rank = F.row_number().over(Window.partitionBy("__source_path", "__block").orderBy("__line"))
    cut = near.where(F.col("__left") < F.col("__rows")).withColumn("__rank", rank).where(F.col("__rank") <= F.col("__left"))
    keep = [F.col(SH.q(c)) for c in own]
    return whole.select(*keep).unionByName(cut.select(*keep))


def load_folder(spark: SparkSession, root: str, dataset: str, glob: str = "*.csv",
                numeric: Sequence[str] | None = None, encoding: str = "UTF-8",
                files: Sequence[str] | None = None, keep_path: bool = False, first_rows: int | None = None) -> DataFrame:
    """SRC-02 / PRJ-08 / PRJ-09 / SET-02: every CSV below ``root`` grouped by header,
    unioned by name (missing columns NULL), tagged with Source_File, Dataset and the
    first folder below root as Attack_Category. ``numeric`` columns are coerced. ``files`` narrows the
    folder to some paths; ``keep_path`` keeps each row's ``__source_path``; ``first_rows`` reads that many rows from the start of
    each file (SRC-08)."""
    paths = spark.createDataFrame([(f,) for f in files], "path string") if files is not None else list_files(spark, root, glob).where("length > 0")
    # one row per header; its paths are what a scan's file index holds anyway
    groups = (file_headers(spark, paths, encoding).where(F.size("header") > 0).groupBy("header")
              .agg(F.sort_array(F.collect_list("path")).alias("paths")).collect())
    groups = sorted(groups, key=lambda g: g["paths"][0])
    frames = [read_group(spark, g["paths"], g["header"], encoding, first_rows=first_rows) for g in groups]
    if not frames:
        return spark.createDataFrame([], "Source_File string, Dataset string, Attack_Category string")
    df = SH.union_by_name(frames)
    df = (df.withColumn("Source_File", F.element_at(F.split("__source_path", "/"), -1))
            .withColumn("Dataset", F.lit(dataset))
            .withColumn("Attack_Category", first_path_segment(F.col("__source_path"), _qualified(spark, root))))
    df = df if keep_path else df.drop("__source_path")
    if numeric:
        df = SH.coerce_numeric(df, [c for c in numeric if c in df.columns])
    return df


def _qualified(spark: SparkSession, root: str) -> str:
    p, fs = _fs(spark, root)
    return str(fs.makeQualified(p).toUri().getPath())


def cap_rows(df: DataFrame, n: int) -> DataFrame:
    """SRC-08: at most n rows overall (the cap is the operator)."""
    return df.limit(n)


def cap_rows_per_file(df: DataFrame, n: int, file_col: str = "Source_File", key: Sequence[str] | None = None) -> DataFrame:
    """A sample of n rows of each file, chosen by hash order of the row, for frames that no longer know their lines;
    ``load_folder(first_rows=n)`` reads the first n lines (SRC-08)."""
    from ..operators.split import first_in_hash_order
    key = list(key) if key else [c for c in df.columns]
    return first_in_hash_order(df, key, [file_col], [lambda _: F.lit(n)]).where("__in0").drop("__in0")


def read_all_csv(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """SRC-03: all CSVs, UTF-8 with a per-file Latin-1 fallback, long rows skipped,
    ``__source_file`` tagged. Files whose UTF-8 decode produced U+FFFD are re-read as Latin-1."""
    utf = load_folder(spark, root, "", glob, keep_path=True).drop("Dataset", "Attack_Category")
    if "__source_path" not in utf.columns:      # no file at all
        return utf.withColumnRenamed("Source_File", "__source_file")
    text_cols = [c for c in utf.columns if c not in ("Source_File", "__source_path")]
    bad = (utf.where(F.exists(F.array(*[F.col(SH.q(c)) for c in text_cols]), lambda v: F.instr(v, "\ufffd") > 0))
           .select("__source_path").distinct())
    paths = [r["__source_path"] for r in bad.collect()]       # whole paths of files: metadata-sized
    if paths:
        # only those files are read again; a file of the same name elsewhere keeps its text
        lat = load_folder(spark, root, "", glob, encoding="ISO-8859-1", files=paths, keep_path=True).drop("Dataset", "Attack_Category")
        utf = utf.join(bad, "__source_path", "left_anti").unionByName(lat, allowMissingColumns=True)
    return utf.drop("__source_path").withColumnRenamed("Source_File", "__source_file")


def load_enterprise(spark: SparkSession, root: str, cfg: DatasetConfig | None = None) -> DataFrame:
    """SRC-04: headers stripped, ``Label`` required, ``dataset_source`` tag."""
    from ..config import ENTERPRISE
    cfg = cfg or ENTERPRISE
    df = load_folder(spark, root, cfg.name, numeric=cfg.features).drop("Dataset", "Attack_Category")
    if cfg.label not in df.columns:
        raise ValueError(f"'{cfg.label}' column missing")
    return df.withColumn("dataset_source", F.lit(cfg.name))


def load_iot(spark: SparkSession, root: str, cfg: DatasetConfig | None = None) -> DataFrame:
    """SRC-05: accepts ``label`` or ``Label``; renamed to ``label``."""
    from ..config import IOT
    cfg = cfg or IOT
    df = load_folder(spark, root, cfg.name, numeric=cfg.features).drop("Dataset")
    if "label" not in df.columns and "Label" in df.columns:
        df = df.withColumnRenamed("Label", "label")
    if "label" not in df.columns:
        raise ValueError("'label' column missing")
    return df.withColumn("dataset_source", F.lit(cfg.name))


def load_combined(frames: Sequence[DataFrame], label: str = "Label") -> DataFrame:
    """SRC-07 / SET-01: stack datasets on their common columns (label and source forced)."""
    fixed = [f.withColumnRenamed("label", label) if "label" in f.columns and label not in f.columns else f for f in frames]
    out = fixed[0]
    for f in fixed[1:]:
        out = SH.union_on_common(out, f, forced=[label, "dataset_source"])
    return out


def count_rows(spark: SparkSession, path: str) -> int:
    """SRC-11: data rows of a CSV (header excluded), counted by executors."""
    return spark.read.option("header", "true").csv(path).count()
