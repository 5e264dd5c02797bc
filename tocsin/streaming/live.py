"""The live flow: feed -> main and late rows -> incidents -> alerts, with statistics refreshed on the way.

Everything lies under one folder ``root``; each micro-batch writes its own ``batch=N`` below a table, so a batch
that runs again after a failure overwrites what it wrote before.

main, late   rows of the feed in time, and those older than the clock allows
clock        the latest time of each batch
assigned     what incident assignment said about the rows of main
stats        transition probabilities by version: those of all that was assigned before the version's time
versions     the versions that are complete
alerts       forecasts that reach the threshold, with their payload
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tocsin.operators.incidents import ASSIGNED, assign, incident_points
from tocsin.operators.messages import top_per
from tocsin.operators.paths import transitions
from tocsin.settings import LIMITS, Limits
from tocsin.sources.tables import payload
from tocsin.streaming.jobs import assign_stream, message_stream

STATS = "type string, from_place string, to_place string, n long, prob double"


def _start(spark: SparkSession, root: str, name: str, schema: str) -> None:
    """Make a table readable before its first batch."""
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{root}/{name}/batch=-1")


def _before(spark: SparkSession, root: str, name: str, batch: int, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch long").parquet(f"{root}/{name}").where(F.col("batch") < batch)


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to the end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def period(ts: Column, seconds: int) -> Column:
    """Start of the period of ``seconds`` that a time lies in, in seconds of the epoch."""
    return (F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)) * seconds).cast("long")


# --- in time or late -------------------------------------------------------------------------------

def split_late(stream: DataFrame, root: str, key: list[str], ts: str = "ts", delay_s: int = 600, keep_s: int = 3600):
    """A query that files the rows of a feed under ``main`` or ``late``.

    A row is late if it is older than the latest time of all earlier batches less ``delay_s``: the watermark that any
    stateful job with this delay behind ``main`` can reach, so such a job drops nothing without a trace. Of rows with the same ``key``
    the first one stays, within ``keep_s`` before the batch. Rows without a time are late. ``main`` is written last; a batch
    that runs again after it was complete changes nothing, so a reader of ``main`` sees each row once. The reader must not
    cut a batch in two, as the second part could be late for it: it takes all files that are there.
    """
    spark = stream.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    for name in ("main", "late"):
        _start(spark, root, name, schema)
    _start(spark, root, "clock", "top timestamp")

    def put(df: DataFrame, batch: int) -> None:
        s = df.sparkSession
        if _complete(s, f"{root}/main/batch={batch}"):
            return
        top = _before(s, root, "clock", batch, "top timestamp").agg(F.max("top")).first()[0]
        clock = F.lit(top).cast("timestamp") - F.expr(f"INTERVAL {delay_s} SECONDS")
        rows = df.dropDuplicates(key).withColumn("_late", F.col(ts).isNull() | F.coalesce(F.col(ts) < clock, F.lit(False))).persist()
        low = rows.agg(F.min(ts)).first()[0]
        known = _before(s, root, "main", batch, schema).where(F.col(ts) >= F.lit(low).cast("timestamp") - F.expr(f"INTERVAL {keep_s} SECONDS"))
        new = rows.join(known.select(*key), key, "left_anti").select(*rows.columns)
        rows.where("_late").drop("_late").write.mode("overwrite").parquet(f"{root}/late/batch={batch}")
        rows.agg(F.max(ts).alias("top")).write.mode("overwrite").parquet(f"{root}/clock/batch={batch}")
        new.where("NOT _late").drop("_late").write.mode("overwrite").parquet(f"{root}/main/batch={batch}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(put)


def rerun(spark: SparkSession, root: str, limits: Limits = LIMITS) -> DataFrame:
    """Assignment of everything that arrived, late rows in their place: the correction of the live tables."""
    return assign(read(spark, root, "main").unionByName(read(spark, root, "late")).where("ts IS NOT NULL"), limits)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}").drop("batch")


# --- statistics ------------------------------------------------------------------------------------

def statistics(assigned: DataFrame) -> DataFrame:
    """Transition probabilities of the points of assigned rows; the places of one message in their order."""
    return transitions(incident_points(assigned).withColumn("event_id", F.struct("event_id", "pos")).drop("pos"))


def refresh(spark: SparkSession, root: str, version: int, batch: int) -> None:
    """Write the statistics of all points before ``version`` and enter the version when they are complete."""
    a = _before(spark, root, "assigned", batch + 1, ASSIGNED).where(F.col("ts") < F.timestamp_seconds(F.lit(version)))
    statistics(a).write.mode("overwrite").parquet(f"{root}/stats/version={version}")
    spark.createDataFrame([(version,)], "version long").write.mode("overwrite").parquet(f"{root}/versions/batch={batch}/version={version}")


def known_versions(spark: SparkSession, root: str) -> set[int]:
    rows = spark.read.schema("version long").option("recursiveFileLookup", "true").parquet(f"{root}/versions")
    return {r[0] for r in rows.distinct().collect()}  # one number for each refresh


# --- alerts ----------------------------------------------------------------------------------------

def forecasts(assigned: DataFrame, stats: DataFrame, every_s: int, k: int = 3) -> DataFrame:
    """The likely next places of each open incident that gained a point, by the statistics of that point's version.

    stats: STATS columns and version. The confidence is the incident's, scaled by half to whole with the probability
    of the likeliest next place; without any statistics it is halved.
    """
    moved = assigned.where((F.size("added") > 0) & F.col("status").isin("Active", "Watch")).select(
        "scope", "message_id", "root", "ts", "type", "category", "status", F.col("confidence").alias("_conf"),
        F.element_at("added", -1)["name"].alias("place"), period(F.col("ts"), every_s).alias("version"))
    best = top_per(stats, ["version", "type", "from_place"], [F.desc("prob"), F.asc("to_place")], k).groupBy(
        "version", "type", F.col("from_place").alias("place")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "to_place"))), lambda x: x["to_place"]).alias("next_places"),
        F.max("prob").alias("_best"))
    j = moved.join(best, ["version", "type", "place"], "left")
    return j.select("scope", "message_id", "root", "ts", "version", "type", "category", "status", "place",
                    F.coalesce("next_places", F.array().cast("array<string>")).alias("next_places"),
                    (F.col("_conf") * (0.5 + 0.5 * F.coalesce("_best", F.lit(0.0)))).alias("confidence"))


def to_alerts(forecast: DataFrame, threshold: float, max_chars: int = 200) -> DataFrame:
    """Forecasts that reach the threshold, with the payload that goes out."""
    f = forecast.where(F.col("confidence") >= threshold)
    text = F.concat(F.col("place"), F.lit(" -> "), F.array_join("next_places", ", "))
    body = payload(F.col("ts"), F.concat(F.lit("channel "), F.col("scope").cast("string")), F.col("type"), F.col("category"),
                   F.array_prepend("next_places", F.col("place")), F.lit(None).cast("string"), F.col("status"),
                   F.round("confidence", 3), text, max_chars)
    return f.withColumn("payload", body)


def emit_alerts(stream: DataFrame, root: str, every_s: int = 3600, limits: Limits = LIMITS, max_chars: int = 200):
    """A query from assigned rows to alerts.

    A batch is stored first. A version that its rows need and that is not there yet is made from what is stored before
    the version's time, so the outcome does not depend on how the feed was cut into batches (for a feed in time order).
    Then the versions are read again: a refresh by another job counts from the next batch on.
    """
    spark = stream.sparkSession
    _start(spark, root, "assigned", ASSIGNED)
    _start(spark, root, "versions", "version long")

    def put(df: DataFrame, batch: int) -> None:
        s = df.sparkSession
        df.write.mode("overwrite").parquet(f"{root}/assigned/batch={batch}")
        own = s.read.schema(ASSIGNED).parquet(f"{root}/assigned/batch={batch}")
        needed = {r[0] for r in own.where(F.size("added") > 0).select(period(F.col("ts"), every_s)).distinct().collect()}
        for version in sorted(needed - known_versions(s, root)):
            refresh(s, root, version, batch)
        if needed:
            stats = s.read.schema(f"{STATS}, version long").parquet(f"{root}/stats").where(F.col("version").isin(sorted(needed)))
            found = to_alerts(forecasts(own, stats, every_s), limits.alert_confidence, max_chars)
            found.write.mode("overwrite").parquet(f"{root}/alerts/batch={batch}")

    return stream.writeStream.foreachBatch(put)


def run_live(spark: SparkSession, feed: str, schema, root: str, every_s: int = 3600, delay_s: int = 600,
             limits: Limits = LIMITS, key: tuple = ("scope", "message_id"), **source) -> None:
    """Take all that lies in ``feed`` through the whole flow and stop; run again, it goes on where it stopped.

    A service starts the two queries with a time trigger instead of ``availableNow``.
    """
    raw = message_stream(spark, feed, schema, **source)
    first = split_late(raw, root, list(key), delay_s=delay_s)
    first.option("checkpointLocation", f"{root}/checkpoints/split").trigger(availableNow=True).start().awaitTermination()
    main = message_stream(spark, f"{root}/main", schema, recursiveFileLookup="true")
    second = emit_alerts(assign_stream(main, limits, f"{delay_s} seconds"), root, every_s, limits)
    second.option("checkpointLocation", f"{root}/checkpoints/alerts").trigger(availableNow=True).start().awaitTermination()
