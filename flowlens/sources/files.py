"""File-level audits over many files at once (SRC-12..14, JOIN-07).

Files are rows of a listing; their bytes are read by tasks as streams (sources/listing.py): 8 KB of each for the audit, all of
them, through a buffer, for a digest. Only for a store that pyarrow cannot open, Spark's ``binaryFile`` reads
whole contents (files below 2 GB).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_filename, first_path_segment
from . import listing as LS

DEFAULT_MAX_BYTES = 500 * 1024 * 1024


def _binary(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
            .load(root))


def audit(spark: SparkSession, root: str, glob: str = "*", max_bytes: int = DEFAULT_MAX_BYTES,
          allowed_ext: tuple[str, ...] = (".csv",)) -> DataFrame:
    """SRC-12: per file -> extension ok, size ok, empty, NUL bytes in the first 8 KB,
    blank header, cleaned file name, and the first failing rule as ``problem``.

    Of a non-empty file within ``max_bytes``, only the first 8 KB are read, by a task.
    """
    from .csv import list_files
    listing = list_files(spark, root, glob).select("path", "length")
    some = listing.first()
    wanted = listing.where((F.col("length") <= max_bytes) & (F.col("length") > 0))
    if some is None or LS.readable(some["path"]):
        heads = LS.first_bytes(_spread(wanted), 8192)
    else:
        b = _binary(spark, root, glob).where((F.col("length") <= max_bytes) & (F.col("length") > 0))
        heads = b.select("path", F.substring(F.col("content"), 1, 8192).alias("head"))
    j = listing.join(heads, "path", "left")
    first = F.split(F.decode(F.col("head"), "UTF-8"), "\n").getItem(0)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    out = j.select(
        "path", "length", clean_filename(F.col("path")).alias("clean_name"), ext.isin(list(allowed_ext)).alias("ext_ok"),
        (F.col("length") == 0).alias("empty"),
        F.coalesce(F.instr(F.decode(F.col("head"), "ISO-8859-1"), "\u0000") > 0, F.lit(False)).alias("has_nul"),
        F.coalesce(F.trim(F.regexp_replace(first, "[,;\r]", "")) == "", F.lit(False)).alias("blank_header"))
    problem = (F.when(F.col("length") > max_bytes, "file too large").when(~F.col("ext_ok"), "not a CSV file")
               .when(F.col("empty"), "empty file").when(F.col("has_nul"), "binary content (NUL bytes)")
               .when(F.col("blank_header"), "blank header"))
    return out.withColumn("problem", problem)


def manifest(spark: SparkSession, root: str, glob: str = "*", version: str = "v1.0.0") -> DataFrame:
    """SRC-13: (name, path, sha256, size_bytes, model_version) for every file (empty files included)."""
    from .csv import list_files
    listing = list_files(spark, root, glob).select("path", "length")
    some = listing.first()
    if some is None or LS.readable(some["path"]):
        found = LS.digests(_spread(listing))
    else:
        found = _binary(spark, root, glob).select("path", F.sha2("content", 256).alias("sha256"))
    j = listing.join(found, "path", "left")
    nothing = F.sha2(F.unhex(F.lit("")), 256)
    return j.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path",
                    F.coalesce("sha256", nothing).alias("sha256"), F.col("length").alias("size_bytes"),
                    F.lit(version).alias("model_version"))


def _spread(paths: DataFrame) -> DataFrame:
    """Paths dealt over tasks, so that files are read side by side."""
    return paths.repartition(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def verify_manifest(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """SRC-13 / JOIN-07: full outer join on name -> ok / changed / missing / new.
    Hashes compare case-insensitively after trimming the expected value."""
    a = actual.select("name", F.lower("sha256").alias("actual_sha256"))
    e = expected.select("name", F.lower(F.trim("sha256")).alias("expected_sha256"))
    j = a.join(e, "name", "full")
    state = (F.when(F.col("actual_sha256").isNull(), "missing").when(F.col("expected_sha256").isNull(), "new")
             .when(F.col("actual_sha256") == F.col("expected_sha256"), "ok").otherwise("changed"))
    return j.withColumn("state", state)


def inventory(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """SRC-14: per file rows, column count, last column name, category folder."""
    from .csv import file_headers, list_files
    listing = list_files(spark, root, glob).select("path", "length")
    found = file_headers(spark, _spread(listing.where("length > 0")))
    meta = listing.select("path").join(found, "path", "left").select(
        "path", F.greatest(F.size("header"), F.lit(0)).alias("columns"), F.try_element_at("header", F.lit(-1)).alias("last_column"))
    rows = (spark.read.option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
            .csv(root).select(F.col("_metadata.file_path").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("rows")))
    from .csv import _qualified
    out = meta.join(rows, "path", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return out.withColumn("category", first_path_segment(F.col("path"), _qualified(spark, root)))
