"""Small helpers shared by the operators: tables, written intermediates, sampling rules."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, shuffles_dropped

# The separators of a word, U+0020 and U+0009 to U+000D, as a regular-expression class body.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder of ``spark.checkpoint.dir`` and read it back.

    Cuts lineage (the files outlive lost executors) and fixes rows whose computation
    must not be repeated."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):  # nothing reads them once the rows are written
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(column: str, parts: int) -> Column:
    """crc32 of the column as text modulo ``parts``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def row_hash(*columns: Column) -> Column:
    """64-bit hash that tells nulls apart (Spark's skips them)."""
    return F.xxhash64(*columns, *(c.isNull() for c in columns))


def words_of(text: Column) -> Column:
    """Array of the words of a text (null: empty array)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{BLANKS}]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row (bound as a lambda variable)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def flag_maybe_in(df: DataFrame, key: Column, keys: DataFrame, flag: str, bits: int = 23) -> DataFrame:
    """Adds a boolean: false only if the row's key is not among ``keys`` (one column).

    A filter of 2**bits bits, built and applied by joins: the table that is broadcast has
    2**(bits - 6) rows at most, whatever the size of ``keys``."""
    name = keys.columns[0]
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << bits) - 1))
    one = F.lit(1).cast("long")
    filled = (keys.select(place(F.col(name)).alias("p"))
              .groupBy(F.shiftright("p", 6).alias("_flag_word"))
              .agg(F.bit_or(F.call_function("shiftleft", one, F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("_flag_bits")))
    row = df.withColumn("_flag_place", place(key))
    hit = F.call_function("shiftright", F.col("_flag_bits"), F.col("_flag_place").bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(one) == 1
    return (row.join(F.broadcast(filled), F.shiftright("_flag_place", 6) == F.col("_flag_word"), "left")
            .withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_flag_place", "_flag_word", "_flag_bits"))


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, bits: int = 23) -> DataFrame:
    """Rows whose key may be among ``keys``: all wanted rows and some others; an exact join follows."""
    return flag_maybe_in(df, key, keys, "_flag_maybe", bits).where("_flag_maybe").drop("_flag_maybe")
