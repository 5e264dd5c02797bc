"""Chat archives: one JSON document with nested messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tocsin.functions.timeparts import local_hour
from tocsin.schemas import ARCHIVE


def flat_text(v: Column) -> Column:
    """Text of a VARIANT: a string as is; of an array its strings and the ``text`` of its objects,
    joined by a space; anything else as its JSON."""
    parts = F.try_variant_get(v, "$", "array<variant>")
    part = lambda p: F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")).when(
        F.schema_of_variant(p).startswith("OBJECT"), _string_at(F.try_variant_get(p, "$.text", "variant")))
    joined = F.array_join(F.transform(parts, part), " ")
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), joined).otherwise(
        F.try_variant_get(v, "$", "string"))


def _string_at(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def message_time(unix_text: Column, date_text: Column) -> Column:
    """Unix seconds when positive, else the ISO date, else any date Spark can cast, else null."""
    secs = F.expr("1") * unix_text.try_cast("bigint")
    return F.coalesce(
        F.when(secs > 0, F.timestamp_seconds(secs)),
        F.try_to_timestamp(date_text, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        date_text.try_cast("timestamp"),
    )


def flatten_archive(docs: DataFrame) -> DataFrame:
    """Rows of RAW_MESSAGE plus ``chat`` and ``rejected`` from documents of the ARCHIVE schema.

    Blank texts are dropped. Rows whose time cannot be read stay, marked ``rejected``.
    """
    m = docs.select("name", F.explode("messages").alias("m"))
    text = flat_text(F.col("m.text"))
    m = m.select("name", "m.*").withColumn("_text", flat_text(F.col("text")))
    at = message_time(F.col("date_unixtime"), F.col("date"))
    keep = m.where(F.length(F.trim(F.regexp_replace(F.coalesce("_text", F.lit("")), r"(?U)\s+", " "))) > 0)
    return keep.select(
        F.col("id").cast("string").alias("message_id"), F.lit("archive").alias("source_type"),
        F.coalesce("from", "name", F.lit("Unknown")).alias("sender"), F.col("_text").alias("text"),
        at.alias("received_at"), at.alias("event_time"), F.lit(3).alias("priority"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
        F.col("reply_to_message_id").cast("string").alias("reply_to"),
        F.coalesce("name", F.lit("Unknown")).alias("chat"), at.isNull().alias("rejected"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A multi-line JSON document is one task by nature: land it as Parquet once, work on that."""
    return flatten_archive(spark.read.schema(ARCHIVE).json(path, multiLine=True))


def land_archive(spark: SparkSession, path: str, out: str) -> None:
    """Archive to Parquet, good rows by day; rejects beside them."""
    rows = read_archive(spark, path)
    good = rows.where(~F.col("rejected")).drop("rejected").withColumn("day", F.to_date("received_at"))
    good.repartition("day", F.pmod(F.xxhash64("message_id"), F.lit(16))).write.mode("append") \
        .partitionBy("day").parquet(f"{out}/messages")
    rows.where("rejected").drop("rejected").write.mode("append").parquet(f"{out}/rejects")


def quality(rows: DataFrame) -> DataFrame:
    """Totals of an import: kept, without a date, first and last time."""
    return rows.agg(
        F.count("*").alias("total"), F.count_if(~F.col("rejected")).alias("kept"),
        F.count_if("rejected").alias("no_date"), F.min("received_at").alias("first_time"),
        F.max("received_at").alias("last_time"))


def busiest_hours(rows: DataFrame, ts: str = "received_at", k: int = 5) -> DataFrame:
    g = rows.where(F.col(ts).isNotNull()).groupBy(local_hour(F.col(ts), 0).alias("hour")).agg(
        F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "hour").limit(k)


def edge_times(rows: DataFrame, k: int = 5, ts: str = "received_at", tie: str = "message_id") -> DataFrame:
    """First and last ``k`` times (side, rank order by time)."""
    r = rows.where(F.col(ts).isNotNull())
    first = r.orderBy(F.col(ts), F.col(tie)).limit(k).select(F.lit("first").alias("side"), tie, ts)
    last = r.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(k).select(
        F.lit("last").alias("side"), tie, ts)
    return first.unionByName(last)
