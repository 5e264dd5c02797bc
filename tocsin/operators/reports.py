"""Aggregate report tables over incidents, points and forecasts of a period."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from tocsin.functions.text import set_jaccard
from tocsin.functions.timeparts import local_hour
from tocsin.operators.paths import steps


def in_period(df: DataFrame, ts: str, start: dt.datetime | None, end: dt.datetime | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end))
    return df


def by_type(incidents: DataFrame) -> DataFrame:
    g = incidents.groupBy("type").agg(F.count("*").alias("n"))
    total = incidents.agg(F.count("*")).scalar()
    return g.select("type", "n", (100.0 * F.col("n") / total).alias("pct"))


def top_steps(points: DataFrame, k: int = 5) -> DataFrame:
    s = steps(points).where("prev IS NOT NULL")
    g = s.groupBy(F.col("prev.place").alias("from_place"), F.col("place").alias("to_place")).agg(
        F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "from_place", "to_place").limit(k)


def top_hours(incidents: DataFrame, offset_hours: int = 3, k: int = 3, ts: str = "first_seen") -> DataFrame:
    g = incidents.groupBy(local_hour(F.col(ts), offset_hours).alias("hour")).agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "hour").limit(k)


def top_places(points: DataFrame, k: int = 5) -> DataFrame:
    g = points.where(F.coalesce("place", F.lit("")) != "").groupBy("place").agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "place").limit(k)


def top_endpoints(points: DataFrame, k: int = 5) -> DataFrame:
    last = points.groupBy("incident_id").agg(
        F.max_by("place", F.struct("ts", "event_id")).alias("place"))
    return top_places(last, k)


def summary(incidents: DataFrame) -> DataFrame:
    closed = F.count_if(F.col("status") == "Terminated")
    return incidents.agg(
        F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"),
        closed.alias("n_terminated"), (100.0 * closed / F.count("*")).alias("pct_terminated"))


def by_predictor(forecasts: DataFrame) -> DataFrame:
    return forecasts.groupBy("predictor").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))


def agreement_rows(forecasts: DataFrame, a: str = "Graph", b: str = "Statistical") -> DataFrame:
    """Latest forecast of both predictors per incident and the Jaccard of their place sets."""
    def latest(name):
        mine = F.col("predictor") == name
        return F.max_by(F.when(mine, F.col("places")), F.when(mine, F.col("created_at")))

    g = forecasts.groupBy("incident_id").agg(latest(a).alias("_a"), latest(b).alias("_b")).where(
        "_a IS NOT NULL AND _b IS NOT NULL")
    low = lambda c: F.array_distinct(F.transform(c, F.lower))
    return g.select("incident_id", set_jaccard(low("_a"), low("_b")).alias("overlap"))


def agreement(forecasts: DataFrame, a: str = "Graph", b: str = "Statistical") -> DataFrame:
    r = agreement_rows(forecasts, a, b)
    hit = F.count_if(F.col("overlap") >= 0.5)
    return r.agg(F.count("*").alias("compared"), hit.alias("matched"),
                 F.when(F.count("*") > 0, 100.0 * hit / F.count("*")).alias("pct"))


def forecasts_in_period(forecasts: DataFrame, incidents: DataFrame, start, end) -> DataFrame:
    """Forecasts of incidents first seen in the period, newest first."""
    inc = in_period(incidents, "first_seen", start, end).select("incident_id")
    return forecasts.join(inc, "incident_id").orderBy(F.desc("created_at"), "incident_id")


def report(incidents: DataFrame, points: DataFrame, forecasts: DataFrame | None, start=None, end=None,
           offset_hours: int = 3) -> dict[str, DataFrame]:
    """All report tables of a period, keyed by name."""
    inc = in_period(incidents, "first_seen", start, end)
    pts = points.join(inc.select("incident_id"), "incident_id", "left_semi")
    out = {
        "types": by_type(inc), "steps": top_steps(pts), "hours": top_hours(inc, offset_hours),
        "places": top_places(pts), "endpoints": top_endpoints(pts), "summary": summary(inc),
    }
    if forecasts is not None:
        fc = forecasts.join(inc.select("incident_id"), "incident_id", "left_semi")
        out["predictors"] = by_predictor(fc)
        out["agreement"] = agreement(fc)
    return out


def report_text(tables: dict[str, DataFrame]) -> DataFrame:
    """The report as text lines (section, line_no, line): every table is already a short top list."""
    parts = None
    for name, df in tables.items():
        line = F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])
        rows = df.select(F.lit(name).alias("section"), line.alias("line"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts
