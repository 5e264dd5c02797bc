"""Filters, classification and routing of message tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tocsin.functions import rules as R
from tocsin.operators.sizing import checked_broadcast


def filter_senders(df: DataFrame, allowed=None, blocked=None, sender: str = "sender") -> DataFrame:
    """Keep senders containing an allowed term (empty list: all), then drop those with a blocked one.

    ``allowed`` / ``blocked`` are lists or one-column tables. Lists become one condition on the row, without a
    shuffle. Tables are tested once per distinct sender, which then meets the messages by an equi-join. A null
    sender contains no term: it is kept unless there are allowed terms.
    """
    key = F.lower(F.coalesce(F.col(sender), F.lit("")))
    for terms, keep in ((allowed, True), (blocked, False)):
        if terms is None or (isinstance(terms, (list, tuple)) and not terms):
            continue
        if isinstance(terms, DataFrame):
            names = df.select(key.alias("_s")).distinct()
            found = checked_broadcast(terms.select(F.lower(F.col(terms.columns[0])).alias("_term")).where("_term is not null"))
            names = names.join(found, F.col("_s").contains(F.col("_term")), "left_semi")
            df = df.withColumn("_s", key).join(names, "_s", "left_semi" if keep else "left_anti").drop("_s")
            continue
        hit = F.lit(False)
        for t in terms:
            hit = hit | key.contains(t.lower())
        df = df.where(hit if keep else ~hit)
    return df


def filter_channels(df: DataFrame, channels: list[str], sender: str = "sender") -> DataFrame:
    """Exact, case-insensitive channel filter; an empty list keeps all."""
    if not channels:
        return df
    return df.where(F.lower(F.col(sender)).isin([c.lower() for c in channels]))


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.length(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")),
                                                     r"(?U)\s+", " "))) > 0)


def classify(df: DataFrame, text: str = "text", terms: dict | None = None) -> DataFrame:
    """Add type, category, status, flags and priority. ``terms`` overrides the default lists."""
    t = terms or {}
    c = F.trim(F.col(text))
    blank = F.length(F.coalesce(c, F.lit(""))) == 0
    out = df.withColumn("type", F.when(blank, "Unknown").otherwise(
        R.event_type(c, t.get("types"), t.get("fibre"))))
    out = out.withColumn("category", F.when(blank, "Unknown").otherwise(
        R.event_category(c, F.col("type"), t.get("drones"), t.get("weather"))))
    out = out.withColumn("status", F.when(blank, "Active").otherwise(
        R.status(c, t.get("clear"), t.get("watch"))))
    out = out.withColumn("flags", F.when(blank, F.array(F.lit("EmptyText"))).otherwise(
        R.flags(c, t.get("clear"), t.get("flags"))))
    return out.withColumn("priority", R.priority_class(c, t.get("priority")))


def score(df: DataFrame, text: str = "text") -> DataFrame:
    """Add base confidence, and the NoSettlements flag, from ``places`` and ``direction``."""
    n = F.size(F.coalesce(F.col("places"), F.array().cast(df.schema["places"].dataType)))
    blank = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) == 0
    conf = R.confidence(n, F.col("type"), F.col("direction"), F.col("status"))
    mark = F.array_union(F.col("flags"), F.array(F.lit("NoSettlements")))
    return (
        df.withColumn("confidence", F.when(blank, 0.3).otherwise(conf))
        .withColumn("flags", F.when((n == 0) & ~blank, mark).otherwise(F.col("flags")))
    )


def route(df: DataFrame) -> DataFrame:
    """located: goes to incident assignment; clear: un-located with a status or flag; plain: neither."""
    located = F.size("places") > 0
    clear = (F.col("status") != "Active") | (F.size("flags") > 0)
    return df.withColumn("route", F.when(located, "located").when(clear, "clear").otherwise("plain"))


def weigh_by_source(df: DataFrame, weights: DataFrame, sender: str = "sender",
                    default: float = 0.5) -> DataFrame:
    """Join source weights (name, weight) and scale the confidence of located messages."""
    w = weights.select(F.col("name").alias(sender), F.col("weight").alias("source_weight"))
    out = df.join(checked_broadcast(w), sender, "left").withColumn(
        "source_weight", F.coalesce("source_weight", F.lit(default)))
    scaled = R.weighted_confidence(F.col("confidence"), F.col("source_weight"))
    return out.withColumn(
        "confidence", F.when(F.size("places") > 0, scaled).otherwise(F.col("confidence")))


def alerts(forecasts: DataFrame, threshold: float) -> DataFrame:
    return forecasts.where(F.col("confidence") >= threshold)


def active(incidents: DataFrame) -> DataFrame:
    return incidents.where(F.col("status").isin("Active", "Watch"))


def latest_per(df: DataFrame, keys: list[str], ts: str, tie: list[str]) -> DataFrame:
    """Insert-or-replace by key: keep the newest row. Partial ``max_by``, so hot keys pre-aggregate."""
    order = F.struct(F.col(ts), *[F.col(t) for t in tie])
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
        .select(*df.columns)
    )


def top_per(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
