"""Small helpers that the operators share."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tocsin.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of digits, lower-case letters and everything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The white space that the line and shingle keys know.
SPACE = "\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def text_key(text: Column) -> Column:
    """A 64-bit key that tells apart rows of one doc_id whose texts differ; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: several readers, one computation, no lineage."""
    return cut_lineage(df, label)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Send texts to Python in batches of ``rows`` at most: a batch is held several times, in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def slices(df: DataFrame, rows_each: int = 4_000) -> int:
    """A number of hash slices that grows with the table: no slice gets unboundedly many rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(parts, math.ceil(df.count() / rows_each))
