"""Dimensions, stored tables and alert payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tocsin.operators.messages import latest_per
from tocsin.schemas import PLACE

_PLACE_JSON = T.StructType([
    T.StructField("Name", T.StringType()), T.StructField("Lat", T.DoubleType()),
    T.StructField("Lon", T.DoubleType()), T.StructField("NeedsReview", T.BooleanType()),
])
_PROFILE_JSON = "map<string, struct<MaxSpeedKmh double, MaxDistanceKm double, LifetimeMinutes double>>"


def first_by_name(places: DataFrame) -> DataFrame:
    """First place of each name, ignoring case."""
    rest = F.struct(*places.columns)
    return places.groupBy(F.lower("name").alias("_n")).agg(F.min_by(rest, "place_id").alias("_r")).select("_r.*")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of {Name, Lat, Lon}; place_id follows the order of the file."""
    raw = spark.read.schema(_PLACE_JSON).json(path, multiLine=True)
    p = raw.select(
        F.monotonically_increasing_id().alias("place_id"), F.col("Name").alias("name"),
        F.col("Lat").alias("lat"), F.col("Lon").alias("lon"),
        F.coalesce("NeedsReview", F.lit(False)).alias("needs_review"))
    return first_by_name(p).select(*[f.name for f in PLACE])


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """JSON map type -> limits as (type, max_speed_kmh, max_distance_km, lifetime_min)."""
    text = spark.read.text(path, wholetext=True)
    m = text.select(F.explode(F.from_json("value", _PROFILE_JSON)).alias("type", "p"))
    return m.select("type", F.col("p.MaxSpeedKmh").alias("max_speed_kmh"),
                    F.col("p.MaxDistanceKm").alias("max_distance_km"),
                    F.col("p.LifetimeMinutes").alias("lifetime_min"))


def upsert_places(places: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace by exact name (changes win), add new names. ``changes`` carries ``changed_at``."""
    old = places.withColumn("changed_at", F.lit(0).cast("timestamp"))
    return latest_per(old.unionByName(changes), ["name"], "changed_at", ["place_id"]).drop("changed_at")


def append_messages(df: DataFrame, path: str, ts: str = "received_at") -> None:
    """Append by day. Replacement by id happens when reading (``current_messages``) or compacting."""
    df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def current_messages(spark: SparkSession, path: str) -> DataFrame:
    """Newest row of each message id."""
    return latest_per(spark.read.parquet(path).drop("day"), ["message_id"], "received_at", [])


def append_forecasts(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("predictor").parquet(path)


def read_incidents(spark: SparkSession, path: str, start=None, end=None, statuses=None) -> DataFrame:
    """Incidents by period and status; both filters reach the scan."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where(F.col("first_seen") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("first_seen") <= F.lit(end))
    return df.where(F.col("status").isin(list(statuses))) if statuses else df


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def payload(ts: Column, sender: Column, type_: Column, category: Column, places: Column,
            direction: Column, status: Column, confidence: Column, text: Column,
            max_chars: int = 200, time_format: str = "HH:mm:ss") -> Column:
    """Alert as JSON of nine fields, cut to ``max_chars`` with ``...``."""
    body = F.to_json(F.struct(
        F.date_format(ts, time_format).alias("timestamp"), sender.alias("sender"),
        type_.alias("threat"), category.alias("category"),
        F.coalesce(F.array_join(places, ","), F.lit("")).alias("settlements"),
        F.coalesce(direction, F.lit("")).alias("direction"), status.alias("status"),
        confidence.alias("confidence"), text.alias("text")), {"ignoreNullFields": "false"})
    cut = F.concat(F.substring(body, 1, max_chars - 3), F.lit("..."))
    return F.when(F.length(body) > max_chars, cut).otherwise(body)
