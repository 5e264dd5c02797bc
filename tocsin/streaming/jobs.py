"""Structured Streaming jobs. Every stateful operator is bounded by a watermark or a lifetime."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tocsin.functions.text import dedup_form, text_hash
from tocsin.operators.dedup import RetainedBuffer
from tocsin.operators.incidents import ASSIGNED, OpenIncidents, result_frame
from tocsin.session import ROCKSDB, scratch_dir, ship_package
from tocsin.settings import LIMITS, Limits


def message_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    """Message feed from files (``fmt``) or Kafka; the schema is always explicit."""
    if fmt == "kafka":
        raw = spark.readStream.format("kafka").options(**options).load()
        return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)


def first_seen_ids(stream: DataFrame, ts: str = "received_at", delay: str = "1 hour") -> DataFrame:
    """Drop ids already seen, bounded by the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["source_type", "message_id"])


def first_seen_texts(stream: DataFrame, scope: str, text: str, ts: str, seconds: int = 120) -> DataFrame:
    """Drop exact repeats of the normalised text inside the window."""
    h = stream.withColumn("hash", text_hash(dedup_form(F.col(text))))
    return h.withWatermark(ts, f"{seconds} seconds").dropDuplicatesWithinWatermark([scope, "hash"])


def hourly_counts(stream: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    g = stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 hour")).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("hour"), "n")


def _stateful(spark: SparkSession) -> None:
    """Stateful Python operators need the package on the workers and the RocksDB state store."""
    ship_package()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Expired(NamedTuple):
    """An incident that ran out, in place of the message that would have touched it."""

    scope: int | None
    message_id: None
    ts: pd.Timestamp
    type: str
    category: str | None


class AssignProcessor(StatefulProcessor):
    """Incident assignment per scope: one map entry per open incident, one timer for the next that expires.

    Only entries that a batch changed are written. An incident that is not seen again for its lifetime leaves
    the state with a row of its own (action ``expired``, at the time it ran out), by a later message or by the timer.
    """

    def __init__(self, limits: Limits = LIMITS):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "root long", "body string")

    def _load(self) -> tuple[OpenIncidents, dict[int, str]]:
        before = {int(k[0]): v[0] for k, v in self.open.iterator()}
        state = OpenIncidents(self.limits)
        state.items = {root: json.loads(body) for root, body in before.items()}
        return state, before

    def _store(self, state: OpenIncidents, before: dict[int, str]) -> None:
        for root in before.keys() - state.items.keys():
            self.open.removeKey((root,))
        for root, inc in state.items.items():
            body = json.dumps(inc)
            if body != before.get(root):
                self.open.updateValue((root,), (body,))
        wanted = {int(min(map(state.due, state.items.values())) * 1000) + 1} if state.items else set()
        timers = set(self.handle.listTimers())
        for t in timers - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - timers:
            self.handle.registerTimer(t)

    @staticmethod
    def _rows(scope, state: OpenIncidents, gone: list[dict]) -> list[tuple]:
        at = lambda i: pd.Timestamp(round(state.due(i) * 1e6), unit="us")
        return [(Expired(scope, None, at(i), i["type"], i["category"]),
                 {"root": i["root"], "action": "expired", "status": "Expired", "confidence": i["conf"]})
                for i in sorted(gone, key=lambda i: (state.due(i), i["root"]))]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "message_id"])
        state, before = self._load()
        out = []
        for r in batch.itertuples(index=False):
            got = [(r, o) for o in state.step(r)]
            out += self._rows(r.scope, state, state.gone) + got
        self._store(state, before)
        yield result_frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, before = self._load()
        # all that the watermark has passed: a timer set here would wait for the next batch
        gone = state.expire(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) / 1000)
        self._store(state, before)
        if gone:
            yield result_frame(self._rows(key[0], state, gone))

    def close(self) -> None:
        pass


def assign_stream(stream: DataFrame, limits: Limits = LIMITS, delay: str = "10 minutes") -> DataFrame:
    """Streaming counterpart of ``incidents.assign`` (SIGHTING columns plus clear_type).

    Besides the rows of the batch job it emits one for each incident that expires.
    """
    _stateful(stream.sparkSession)
    return stream.withWatermark("ts", delay).groupBy("scope").transformWithStateInPandas(
        statefulProcessor=AssignProcessor(limits), outputStructType=ASSIGNED, outputMode="Append",
        timeMode="EventTime")


class DedupProcessor(StatefulProcessor):
    """Greedy near-duplicate marking per scope over the last retained messages."""

    def __init__(self, seconds: int = 120, size: int = 50, threshold: float = 0.9):
        self.args = (seconds, size, threshold)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "t double, message_id long, body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        buf = RetainedBuffer(*self.args)
        for t, mid, body in (self.kept.get() if self.kept.exists() else []):
            buf.keep(t, mid, body)
        batch = pd.concat(list(rows)).sort_values(["ts", "message_id"])
        ids, dup, sim = [], [], []
        for r in batch.itertuples(index=False):
            t = r.ts.value / 1e9
            hit = buf.find(t, r.body)
            if hit is None:
                buf.keep(t, int(r.message_id), r.body)
            ids.append(int(r.message_id))
            dup.append(hit[0] if hit else None)
            sim.append(hit[1] if hit else None)
        self.kept.put([(float(t), int(i), b) for t, i, b, _ in buf.items])
        yield pd.DataFrame({"message_id": ids, "duplicate_of": pd.array(dup, dtype="Int64"),
                            "similarity": pd.Series(sim, dtype="float64")})

    def close(self) -> None:
        pass


def retained_stream(stream: DataFrame, scope: str, text: str, ts: str, key: str, seconds: int = 120,
                    size: int = 50, threshold: float = 0.9) -> DataFrame:
    _stateful(stream.sparkSession)
    s = stream.select(F.col(scope).alias("scope"), F.col(key).alias("message_id"), F.col(ts).alias("ts"),
                      dedup_form(F.col(text)).alias("body"))
    return s.withWatermark("ts", f"{seconds} seconds").groupBy("scope").transformWithStateInPandas(
        statefulProcessor=DedupProcessor(seconds, size, threshold),
        outputStructType="message_id long, duplicate_of long, similarity double",
        outputMode="Append", timeMode="EventTime")


def context_stream(stream: DataFrame, scope: str, ts: str, key: str, minutes: float = 5.0) -> DataFrame:
    """Stream-stream join: un-located messages with the located ones of the last ``minutes``."""
    gap = f"{int(minutes * 60)} seconds"
    left = stream.where("n_places = 0").withWatermark(ts, gap)
    right = stream.where("n_places > 0").select(
        F.col(scope).alias("_scope"), F.col(ts).alias("_ts"), F.col(key).alias("context_id")
    ).withWatermark("_ts", gap)
    on = (F.col(scope) == F.col("_scope")) & (F.col("_ts") <= F.col(ts)) & (
        F.col("_ts") >= F.col(ts) - F.expr(f"INTERVAL {gap}"))
    return left.join(right, on).select(key, "context_id")


def write_idempotent(stream: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """Append each micro-batch once, under its own batch folder: a replay overwrites the same folder."""
    def put(df: DataFrame, batch_id: int) -> None:
        df.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process everything available now into the shared folder; returns the result as a batch table."""
    spark = stream.sparkSession
    out, ckpt = scratch_dir(spark, label), scratch_dir(spark, f"{label}-ckpt")
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
