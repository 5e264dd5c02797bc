"""From raw messages to incidents, forecasts and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tocsin.functions import rules as R
from tocsin.functions.text import clean_message, tokens
from tocsin.operators import context as C, gazetteer as G, incidents as I, messages as M
from tocsin.plans import forecasts as FC
from tocsin.session import cut_lineage
from tocsin.settings import LIMITS, STOP_WORDS, STOP_WORDS_TFIDF, Limits

_NO_PLACES = "array<struct<name:string,lat:double,lon:double>>"

#: context plug-in registry: name -> function(messages) returning (key, context_id, score)
CONTEXTS = {
    "simple": lambda m: C.token_context(m, ["chat"], "ts", "mid", "tokens"),
    "tfidf": lambda m: C.tfidf_context(m, ["chat"], "ts", "mid", "tokens_tfidf"),
}


def context_of(messages: DataFrame, mode: str) -> DataFrame:
    if mode == "ensemble":
        return C.combined_context(CONTEXTS["simple"](messages), CONTEXTS["tfidf"](messages), messages,
                                  "ts", "mid")
    return CONTEXTS[mode](messages)


def parse(raw: DataFrame, places: DataFrame, weights: DataFrame | None = None, mode: str = "simple",
          allowed=None, blocked=None, scan_rows: int = G.SCAN_ROWS) -> DataFrame:
    """Raw messages (RAW_MESSAGE columns plus ``chat``) to parsed messages.

    Filters, classification, places, direction, confidence, reply context, recent context, route and
    source weight, in that order.
    """
    m = M.drop_blank(M.filter_senders(raw, allowed, blocked))
    m = m.withColumns({"text": clean_message(F.col("text")), "mid": F.xxhash64("chat", "message_id"),
                       "ts": F.coalesce("event_time", "received_at")})
    found = cut_lineage(G.extract_places(m, places, "mid", scan_rows=scan_rows), "places")
    toward = G.directions(m, places, found, "mid", scan_rows=scan_rows)
    m = M.classify(m).join(found, "mid", "left").join(toward, "mid", "left")
    m = M.score(m.withColumn("places", F.coalesce("places", F.array().cast(_NO_PLACES))))
    m = C.reply_context(m)
    m = m.withColumns({"n_places": F.size("places"), "tokens": tokens(F.col("text"), STOP_WORDS, 3),
                       "tokens_tfidf": tokens(F.col("text"), STOP_WORDS_TFIDF, 2)})
    m = cut_lineage(m, "replies")
    m = C.apply_context(m, context_of(m, mode), "mid").drop("tokens", "tokens_tfidf")
    m = M.route(m.withColumn("n_places", F.size("places")))
    return M.weigh_by_source(m, weights) if weights is not None else m


def sightings(parsed: DataFrame) -> DataFrame:
    """Parsed messages as input of incident assignment; the scope is the chat."""
    return parsed.select(
        F.xxhash64("chat").alias("scope"), F.col("mid").alias("message_id"), "ts", "type", "category",
        "status", F.array_contains("flags", "Destroyed").alias("destroyed"), "confidence", "places",
        F.when(F.size("places") == 0, R.clear_type(F.col("text"))).alias("clear_type"))


@dataclass
class Outcome:
    messages: DataFrame
    incidents: DataFrame
    points: DataFrame


def process(raw: DataFrame, places: DataFrame, weights: DataFrame | None = None, mode: str = "simple",
            allowed=None, blocked=None, as_of=None, limits: Limits = LIMITS) -> Outcome:
    """Messages with their incident, incidents and points."""
    parsed = cut_lineage(parse(raw, places, weights, mode, allowed, blocked), "parsed")
    assigned = I.assign(sightings(parsed), limits)
    # a point is ordered by its message, then by its position in the message
    pts = I.incident_points(assigned).withColumn("event_id", F.struct("event_id", "pos")).drop("pos")
    pts = cut_lineage(pts, "points")
    sizes = pts.groupBy("incident_id").agg(F.count("*").alias("n_points"))
    inc = I.incident_table(assigned, as_of, limits).join(sizes, "incident_id", "left")
    inc = cut_lineage(inc.withColumn("n_points", F.coalesce("n_points", F.lit(0))), "incidents")
    touched = assigned.where("root IS NOT NULL").groupBy("message_id").agg(
        F.min(I.incident_id()).alias("incident_id"))
    out = parsed.join(touched.withColumnRenamed("message_id", "mid"), "mid", "left")
    return Outcome(out, inc, pts)


def forecast(outcome: Outcome, places: DataFrame, enabled: list[str] | None = None, weight: float = 0.5,
             limits: Limits = LIMITS) -> DataFrame:
    """Forecasts of the open incidents, with all incidents as history."""
    inc = outcome.incidents.where("n_points > 0")
    x = FC.Inputs(incidents=inc, points=outcome.points, places=places, weight=weight, limits=limits)
    return FC.forecast(x, enabled)
