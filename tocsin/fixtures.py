"""Views that give the test tables the shape of the jobs' inputs.

The tables carry no coordinates and no warnings, so places, points, sightings and messages are derived
from them row by row; ``tocsin.catalog.oracle`` derives the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tocsin.functions.text import plain_words, tokens

TYPES = ["FPV", "Recon", "StrikeDrone", "Rocket", "Unknown"]
BASE = "2024-01-01 00:00:00"

#: term lists for the invented prose of the test tables
TERMS = {
    "fibre": ["worthless"],
    "types": [("schieß", "FPV"), ("thention", "Recon"), ("mentque", None), ("ouai", "Rocket"),
              ("ungung", "StrikeDrone"), ("eux", "Drone"), ("ando", "Rocket"), ("ing", "FPV")],
    "weather": ["nicht", "para"],
    "clear": [("ndst", False), ("ierme", False), ("erlich", True), ("quela", True)],
    "watch": ["hand", "schein", "ment pour"],
    "flags": [("TakeCover", ["tionon", "chung"]), ("StopMovement", ["ouest"]), ("Confirmed", ["pare"])],
    "priority": [(["schieß", "ouaiou"], 0), (["ungung", "ndst"], 1), (["thention"], 2),
                 (["eux", "ando"], 3), (["ing", ("der", "und")], 4)],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for f in df.schema:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def type_of(number) -> F.Column:
    return F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.pmod(number, F.lit(5)) + 1).cast("int"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.cast("long").alias("place_id"), F.col("s_name").alias("name"),
        (49.5 + (k * 37 % 200) / 100.0).alias("lat"), (36.5 + (k * 53 % 250) / 100.0).alias("lon"))


def _placed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    n = p.agg(F.count("*")).scalar()
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    e = e.withColumn("place_id", F.pmod(F.col("event_id") * 17, n))
    return e.join(p.withColumnRenamed("name", "place"), "place_id")


def _mark():
    t = F.col("event_type")
    return F.when(t == "signup", "Watch").when(t == "error", "Terminated").otherwise("Active")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident = the events of one user on one day; its type follows the user."""
    return _placed_events(spark, sf_dir).select(
        (F.col("user_id") * 100_000 + F.unix_date(F.to_date("ts"))).alias("incident_id"),
        type_of(F.col("user_id")).alias("type"), "ts", "event_id", "place_id", "place", "lat", "lon",
        _mark().alias("mark"))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of channel groups of ten users. Errors are all-clears, a third without place."""
    lost = (F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)
    typ = type_of(F.col("user_id"))
    spot = F.array(F.struct(F.col("place").alias("name"), "lat", "lon"))
    return _placed_events(spark, sf_dir).select(
        F.floor(F.col("user_id") / 10).cast("long").alias("scope"), F.col("event_id").alias("message_id"),
        "ts", typ.alias("type"), F.when(typ == "Rocket", "Missile").otherwise("Drone").alias("category"),
        _mark().alias("status"), F.lit(False).alias("destroyed"), F.lit(0.5).alias("confidence"),
        F.when(lost, F.array().cast("array<struct<name:string,lat:double,lon:double>>")).otherwise(spot)
        .alias("places"),
        F.when(lost & (F.col("event_id") % 2 == 0), typ).alias("clear_type"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages: one per second, the source is the sender."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("message_id"), F.col("source").alias("sender"), "lang", "text",
        F.timestamp_seconds(F.unix_seconds(F.lit(BASE).cast("timestamp")) + F.col("doc_id")).alias("ts"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as messages 45 s apart; user turns name one or two places, others none."""
    c, t = F.col("conv_id"), F.col("turn")
    mid = c * 1000 + t
    n = F.when(F.col("role") == "user", 1 + t % 2).otherwise(0).cast("int")
    two = F.array(*[F.struct(F.concat(F.lit(f"p{i}-"), mid.cast("string")).alias("name"),
                             F.lit(50.0).alias("lat"), F.lit(37.0).alias("lon")) for i in (1, 2)])
    return table(spark, sf_dir, "conversations").select(
        c.alias("chat"), mid.alias("message_id"), F.when(t > 0, mid - 1).alias("reply_to"), "text",
        F.timestamp_seconds(F.unix_seconds(F.lit(BASE).cast("timestamp")) + c * 3600 + t * 45).alias("ts"),
        type_of(c + t).alias("type"), F.lit("Drone").alias("category"), F.lit("Active").alias("status"),
        F.lit(None).cast("string").alias("direction"),
        F.when(n > 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("NoSettlements")))
        .alias("flags"),
        F.when(n > 0, 0.75).otherwise(0.3).alias("confidence"), n.alias("n_places"),
        F.slice(two, F.lit(1), n).alias("places"), tokens(F.col("text"), [], 3).alias("tokens"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer over the prose: the distinct words of eight letters or more in ``benchmark``."""
    b = table(spark, sf_dir, "benchmark")
    w = b.select("item_id", F.explode(F.split(plain_words(F.col("text")), " ")).alias("name")).where(
        F.length("name") >= 8)
    g = w.groupBy("name").agg(F.count("*").alias("n"))
    code = F.conv(F.substring(F.md5("name"), 1, 12), 16, 10).cast("long")
    return g.select(code.alias("place_id"), "name", (49.5 + code % 200 / 100.0).alias("lat"),
                    (36.5 + code % 250 / 100.0).alias("lon"))
