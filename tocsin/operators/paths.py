"""Statistics over incident points.

points: incident_id, type, ts, event_id, place, lat, lon [, mark]
incidents: incident_id, type, first_seen, last_seen, status, confidence, n_points, has_recon
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tocsin.functions.geo import bearing_deg, haversine_km
from tocsin.functions.rules import clamp01
from tocsin.functions.timeparts import day_name, hours_between, season, time_of_day
from tocsin.operators.messages import top_per
from tocsin.operators.ordered import previous_row, running_totals

TIE = ["event_id"]
POINT = ["place", "lat", "lon", "ts"]


def steps(points: DataFrame) -> DataFrame:
    """Each point with ``prev``: place, lat, lon, ts of the point before it in the incident."""
    return previous_row(points, ["incident_id"], "ts", TIE, POINT)


def step_km() -> Column:
    return haversine_km(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon"))


def rollup(points: DataFrame, base: float = 0.4, located: float = 0.1, watch: float = 0.2) -> DataFrame:
    """Incidents from their points: times, size, status and accumulated confidence.

    Every step adds a non-negative amount and caps at 1, so the final value is the capped sum.
    """
    latest = F.max_by("mark", F.struct("ts", "event_id"))
    g = points.groupBy("incident_id", "type").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.count("*").alias("n_points"), latest.alias("_mark"),
        F.count_if(F.col("mark") == "Watch").alias("_watch"),
        F.max(F.when(F.col("mark") == "Watch", F.col("ts"))).alias("recon_time"))
    status = F.when(F.col("_mark") == "Terminated", "Terminated").when(
        F.col("_watch") > 0, "Watch").otherwise("Active")
    conf = F.least(F.lit(1.0), base + located * F.col("n_points") + watch * F.col("_watch"))
    return g.select("incident_id", "type", "first_seen", "last_seen", status.alias("status"),
                    conf.alias("confidence"), "n_points", (F.col("_watch") > 0).alias("has_recon"),
                    "recon_time")


def distinct_points(points: DataFrame) -> DataFrame:
    """First point of each (incident, place, coordinates rounded to 4 decimals)."""
    keys = ["incident_id", "place", F.round("lat", 4).alias("_la"), F.round("lon", 4).alias("_lo")]
    rest = F.struct(*[F.col(c) for c in points.columns if c not in ("incident_id", "place")])
    return (
        points.groupBy(*keys).agg(F.min_by(rest, F.struct("ts", "event_id")).alias("_r"))
        .select("incident_id", "place", "_r.*").select(*points.columns)
    )


# --- transitions --------------------------------------------------------------------------------

def transitions(points: DataFrame) -> DataFrame:
    """(type, from_place, to_place, n, prob) over each incident's distinct places in first-seen order."""
    firsts = points.groupBy("incident_id", "type", "place").agg(
        F.min(F.struct("ts", "event_id")).alias("_f")
    ).select("incident_id", "type", "place", "_f.ts", "_f.event_id")
    moved = previous_row(firsts, ["incident_id"], "ts", TIE, ["place"]).where("prev IS NOT NULL")
    n = moved.groupBy("type", F.col("prev.place").alias("from_place"),
                      F.col("place").alias("to_place")).agg(F.count("*").alias("n"))
    total = n.groupBy("type", "from_place").agg(F.sum("n").alias("_t"))
    return n.join(total, ["type", "from_place"]).select(
        "type", "from_place", "to_place", "n", (F.col("n") / F.col("_t")).alias("prob"))


def incoming_weights(trans: DataFrame) -> DataFrame:
    """(type, place, weight): 0.5 + the highest probability of arriving at the place."""
    return trans.groupBy("type", F.col("to_place").alias("place")).agg(
        (0.5 + F.max("prob")).alias("weight"))


def incoming_weights_from(trans: DataFrame) -> DataFrame:
    """Variant conditioned on the current place: (type, from_place, place, weight)."""
    return trans.select("type", "from_place", F.col("to_place").alias("place"),
                        (0.5 + F.col("prob")).alias("weight"))


def last_points(points: DataFrame, n: int) -> DataFrame:
    """The last ``n`` points of each incident; rank 1 is the last."""
    return top_per(points, ["incident_id"], [F.col("ts").desc(), F.col("event_id").desc()], n)


def chains(points: DataFrame) -> DataFrame:
    """Last three points of incidents with three or more: p1 -> p2 -> p3 and the length of both legs."""
    item = F.struct("place", "lat", "lon")
    at = lambda r: F.max(F.when(F.col("rank") == r, item))
    g = last_points(points, 3).groupBy("incident_id", "type").agg(
        at(3).alias("a"), at(2).alias("b"), at(1).alias("c")).where("a IS NOT NULL")
    km = haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) + haversine_km(
        F.col("b.lat"), F.col("b.lon"), F.col("c.lat"), F.col("c.lon"))
    return g.select("incident_id", "type", F.col("a.place").alias("k1"), F.col("b.place").alias("k2"),
                    F.col("c.place").alias("k3"), km.alias("km"))


def _smoothed(n: Column, total: Column, kinds: Column) -> Column:
    return (n + 1.0) / (total + kinds)


def direction_stats(points: DataFrame, weight: float = 0.5) -> DataFrame:
    """(type, k1, k2, k3, n, prob, avg_km, avg_weight) of single steps (k3 null) and last chains.

    Probabilities are smoothed over all steps and chains of a type; a chain counts two legs.
    """
    one = steps(points).where("prev IS NOT NULL").select(
        "type", F.col("prev.place").alias("k1"), F.col("place").alias("k2"),
        F.lit(None).cast("string").alias("k3"), step_km().alias("km"), F.lit(1).alias("legs"))
    two = chains(points).select("type", "k1", "k2", "k3", "km", F.lit(2).alias("legs"))
    g = one.unionByName(two).groupBy("type", "k1", "k2", "k3").agg(
        F.count("*").alias("n"), (F.sum("km") / F.sum("legs")).alias("avg_km"))
    total = g.groupBy("type").agg(F.sum("n").alias("_t"), F.count("*").alias("_k"))
    return g.join(total, "type").select(
        "type", "k1", "k2", "k3", "n", _smoothed(F.col("n"), F.col("_t"), F.col("_k")).alias("prob"),
        "avg_km", F.lit(float(weight)).alias("avg_weight"))


def time_pattern(incidents: DataFrame) -> DataFrame:
    """(type, tod, dow, n, prob): smoothed share of each time of day and weekday."""
    g = incidents.groupBy("type", time_of_day(F.col("first_seen")).alias("tod"),
                          day_name(F.col("first_seen")).alias("dow")).agg(F.count("*").alias("n"))
    total = g.groupBy("type").agg(F.sum("n").alias("_t"), F.count("*").alias("_k"))
    return g.join(total, "type").select(
        "type", "tod", "dow", "n", _smoothed(F.col("n"), F.col("_t"), F.col("_k")).alias("prob"))


# --- features and graph -----------------------------------------------------------------------------

def tenth(c: Column) -> Column:
    """Half-even rounding to one decimal."""
    return F.rint(c * 10) / 10


def speed_bin(speed: Column) -> Column:
    return (F.when(speed < 10, "Slow").when(speed < 50, "Medium").when(speed < 150, "Fast")
            .otherwise("VeryFast"))


def features(points: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row per incident: path length, mean speed, regions, calendar parts and end points."""
    order = F.struct("ts", "event_id")
    spot = F.struct("place", "lat", "lon")
    path = steps(points).groupBy("incident_id").agg(
        F.coalesce(F.sum(step_km()), F.lit(0.0)).alias("path_km"),
        F.min_by(spot, order).alias("_a"), F.max_by(spot, order).alias("_z"),
        F.round(F.avg("lat"), 9).alias("_la"), F.round(F.avg("lon"), 9).alias("_lo"),
        F.countDistinct("place").alias("n_places"))
    f = incidents.join(path, "incident_id")
    hours = hours_between(F.col("last_seen"), F.col("first_seen"))
    same = F.col("_a.place") == F.col("_z.place")
    short = lambda c: F.regexp_replace(F.format_string("%.1f", tenth(c)), r"\.0$", "")
    mid = lambda x: F.format_string("%.1f", tenth((F.col(f"_a.{x}") + F.col(f"_z.{x}")) / 2))
    f = f.withColumn("avg_speed", F.when(hours > 0.01, F.col("path_km") / hours).otherwise(0.0))
    return f.select(
        "incident_id", "type", "first_seen", "last_seen", "status", "confidence", "n_points",
        "has_recon", "path_km", "avg_speed", "n_places",
        time_of_day(F.col("first_seen")).alias("tod"), season(F.col("first_seen")).alias("season"),
        day_name(F.col("first_seen")).alias("dow"), speed_bin(F.col("avg_speed")).alias("speed_bin"),
        F.when(same, F.col("_a.place")).otherwise(
            F.concat_ws("_", short(F.col("_la")), short(F.col("_lo")))).alias("region"),
        F.when(same, F.col("_a.place")).otherwise(
            F.concat_ws("_", mid("lat"), mid("lon"))).alias("region_key"),
        F.col("_a").alias("first_point"), F.col("_z").alias("last_point"))


NODE_KEY = ["type", "tod", "season", "dow", "has_recon", "speed_bin", "region_key"]


def node_id() -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in NODE_KEY])


def graph_nodes(feats: DataFrame, weight: float = 0.5) -> DataFrame:
    """Incidents grouped by feature combination; metrics are those of the earliest incident."""
    order = F.struct("first_seen", "incident_id")
    first = F.min_by(F.struct("avg_speed", "path_km", "n_points"), order)
    return feats.groupBy(*NODE_KEY).agg(
        F.count("*").alias("n"), F.min(order).alias("first_rank"), first.alias("_m")
    ).select(node_id().alias("node_id"), *NODE_KEY, "n", F.lit(float(weight)).alias("weight"),
             "first_rank", "_m.avg_speed", "_m.path_km", "_m.n_points")


def edge_rows(feats: DataFrame, near_km: float = 50.0, fpv_km: float = 10.0, rocket_km: float = 100.0,
              max_hours: float = 24.0) -> DataFrame:
    """Consecutive incidents (by first_seen) close enough in space and time, as (src, dst) rows."""
    f = feats.withColumn("node_id", node_id())
    p = previous_row(f, [], "first_seen", ["incident_id"],
                     ["node_id", "type", "last_point", "first_seen"], "p")
    km = haversine_km(F.col("p.last_point.lat"), F.col("p.last_point.lon"),
                      F.col("first_point.lat"), F.col("first_point.lon"))
    either = lambda t: (F.col("type") == t) | (F.col("p.type") == t)
    limit = F.when(either("FPV"), fpv_km).when(either("Rocket"), rocket_km).otherwise(near_km)
    hours = hours_between(F.col("first_seen"), F.col("p.first_seen"))
    e = p.where(F.col("p").isNotNull()).select(
        F.col("p.node_id").alias("src"), F.col("node_id").alias("dst"), "first_seen", "incident_id",
        km.alias("km"), hours.alias("hours"), limit.alias("_limit"))
    return e.where((F.col("km") <= F.col("_limit")) & (F.col("hours") <= max_hours)).drop("_limit")


def delay_deviation(rows: DataFrame) -> DataFrame:
    """(src, dst, delay_dev): root of the mean squared gap to the mean of the earlier delays."""
    r = rows.withColumn("_one", F.lit(1))
    t = running_totals(r, ["src", "dst"], "first_seen", ["incident_id"],
                       {"_sum": "hours", "_n": "_one"}, 86_400)
    before = (F.col("_sum") - F.col("hours")) / (F.col("_n") - 1)
    sq = F.when(F.col("_n") > 1, F.pow(F.col("hours") - before, F.lit(2.0)))
    return t.groupBy("src", "dst").agg(F.count("*").alias("_c"), F.sum(sq).alias("_q")).select(
        "src", "dst",
        F.when(F.col("_c") > 1, F.sqrt(F.col("_q") / (F.col("_c") - 1))).otherwise(0.0).alias("delay_dev"))


def graph_edges(rows: DataFrame) -> DataFrame:
    """Edges with count, mean delay, deviation, mean distance and smoothed probability."""
    g = rows.groupBy("src", "dst").agg(
        F.count("*").alias("n"), F.avg("hours").alias("delay_mean"), F.avg("km").alias("km_mean"),
        F.max("first_seen").alias("last_time"))
    total = g.groupBy("src").agg(F.sum("n").alias("_t"), F.count("*").alias("_k"))
    return (
        g.join(total, "src").join(delay_deviation(rows), ["src", "dst"])
        .select("src", "dst", "n", _smoothed(F.col("n"), F.col("_t"), F.col("_k")).alias("prob"),
                "delay_mean", "delay_dev", "km_mean", "last_time")
    )


# --- zones ------------------------------------------------------------------------------------------------

def zones(points: DataFrame, max_km: Column, margin: float = 3.0) -> DataFrame:
    """Centre and radius per incident: farthest point + 3 km, at most max_km + 3. ``max_km`` by type."""
    centre = points.groupBy("incident_id").agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))
    d = haversine_km(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon"))
    return points.join(centre, "incident_id").groupBy("incident_id", "type").agg(
        F.max("clat").alias("center_lat"), F.max("clon").alias("center_lon"),
        F.max(d).alias("_far"), F.count("*").alias("n")
    ).select("incident_id", "type", "center_lat", "center_lon",
             F.least(F.col("_far") + margin, max_km + margin).alias("radius_km"), "n")


def update_zones(zone_points: DataFrame, new_points: DataFrame, max_km: Column) -> DataFrame:
    """Zones after merging points with new names: recomputed centre and radius, weight = 1 + updates.

    An update is one batch of new points (column ``batch``); names already present add no point.
    """
    cols = ["incident_id", "type", "place", "lat", "lon"]
    merged = (
        zone_points.select(*cols, F.lit(0).alias("_new")).unionByName(
            new_points.select(*cols, F.lit(1).alias("_new")))
        .groupBy("incident_id", F.lower("place").alias("_p"))
        .agg(F.min_by(F.struct("type", "place", "lat", "lon"), "_new").alias("_r"))
        .select("incident_id", "_r.*")
    )
    weight = new_points.groupBy("incident_id").agg(F.countDistinct("batch").alias("_u"))
    return zones(merged, max_km).join(weight, "incident_id", "left").withColumn(
        "weight", 1.0 + F.coalesce("_u", F.lit(0))).drop("_u")


# --- speed ---------------------------------------------------------------------------------------------------

def recent_track(points: DataFrame, n: int = 5) -> DataFrame:
    """Last ``n`` distinct coordinates (4 decimals) of each incident: newest point of each, in order of
    first occurrence. Column pos counts from the oldest kept one."""
    g = points.groupBy("incident_id", "type", F.round("lat", 4).alias("_la"),
                       F.round("lon", 4).alias("_lo")).agg(
        F.min(F.struct("ts", "event_id")).alias("_o"),
        F.max_by(F.struct("lat", "lon", "ts"), F.struct("ts", "event_id")).alias("_p"))
    t = top_per(g, ["incident_id"], [F.col("_o").desc()], n)
    return t.select("incident_id", "type", "rank", "_p.lat", "_p.lon", "_p.ts")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """With ``value`` made once a row: the optimizer does not copy it into later filters and expressions."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def speed_stats(points: DataFrame, n: int = 5) -> DataFrame:
    """Track summary per incident with two coordinates or more: speeds, stability, heading, ends."""
    item = F.struct((-F.col("rank")).alias("o"), "lat", "lon", "ts")
    t = recent_track(points, n).groupBy("incident_id", "type").agg(
        F.array_sort(F.collect_list(item)).alias("t")).where(F.size("t") >= 2)
    legs = F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", F.lit(2), F.size("t") - 1),
                      lambda a, b: F.struct(
                          haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]).alias("km"),
                          hours_between(b["ts"], a["ts"]).alias("h")))
    v = F.transform(F.filter(legs, lambda x: x["h"] > 0.001), lambda x: x["km"] / x["h"])
    t = once(t, "v", v)
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    mean = F.when(F.size("v") > 0, total(F.col("v")) / F.size("v")).otherwise(0.0)
    t = t.withColumn("mean_speed", mean)
    sq = total(F.transform("v", lambda x: F.pow(x - F.col("mean_speed"), F.lit(2.0))))
    t = t.withColumn("speed_dev", F.when(F.size("v") > 0, F.sqrt(sq / F.size("v"))).otherwise(0.0))
    first, last, prev = (F.try_element_at("t", F.lit(i)) for i in (1, -1, -2))
    t = t.withColumn("first_pt", first).withColumn("last_pt", last).withColumn("prev_pt", prev)
    whole = haversine_km(F.col("first_pt.lat"), F.col("first_pt.lon"), F.col("last_pt.lat"),
                         F.col("last_pt.lon"))
    span = hours_between(F.col("last_pt.ts"), F.col("first_pt.ts"))
    speed = F.when((F.col("mean_speed") < 0.1) & (span > 0.001) & (whole > 0.5), whole / span).otherwise(
        F.col("mean_speed"))
    t = once(t, "speed", speed)
    stability = F.when((F.size("t") >= 3) & (F.col("mean_speed") > 0),
                       F.greatest(F.lit(0.0), 1 - F.col("speed_dev") / F.col("mean_speed"))).otherwise(0.0)
    return t.select(
        "incident_id", "type", F.size("t").alias("n_track"), "mean_speed", "speed_dev",
        "speed", stability.alias("stability"),
        bearing_deg(F.col("prev_pt.lat"), F.col("prev_pt.lon"), F.col("last_pt.lat"),
                    F.col("last_pt.lon")).alias("bearing"),
        F.col("last_pt.lat").alias("lat"), F.col("last_pt.lon").alias("lon"),
        F.col("last_pt.ts").alias("ts"))


# --- source reliability -----------------------------------------------------------------------------------------

def source_weights(messages: DataFrame, initial: DataFrame | None = None, sender: str = "sender",
                   confirmed: str = "confirmed", default: float = 0.5) -> DataFrame:
    """(name, total, confirmed, initial_weight, weight): mean of the initial weight and the confirmed share."""
    g = messages.groupBy(F.col(sender).alias("name")).agg(
        F.count("*").alias("total"), F.count_if(F.col(confirmed)).alias("n_confirmed"))
    if initial is not None:
        g = g.join(initial.select("name", "initial_weight"), "name", "left")
    else:
        g = g.withColumn("initial_weight", F.lit(None).cast("double"))
    g = g.withColumn("initial_weight", F.coalesce("initial_weight", F.lit(default)))
    share = F.col("n_confirmed") / F.greatest(F.lit(1), F.col("total"))
    return g.withColumn("weight", clamp01((F.col("initial_weight") + share) / 2))


def source_history(messages: DataFrame, ts: str, tie: list[str], sender: str = "sender",
                   confirmed: str = "confirmed", default: float = 0.5) -> DataFrame:
    """Weight of the sender after each of its messages."""
    m = messages.withColumn("_one", F.lit(1)).withColumn("_hit", F.col(confirmed).cast("int"))
    r = running_totals(m, [sender], ts, tie, {"total": "_one", "n_confirmed": "_hit"}, 3600)
    return r.withColumn("weight", clamp01((default + F.col("n_confirmed") / F.col("total")) / 2)).drop(
        "_one", "_hit")


def initialise_sources(sources: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-or-ignore by name."""
    return sources.unionByName(new.join(sources.select("name"), "name", "left_anti"))


def reset_sources(sources: DataFrame, resets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply (name, new_weight, reason, changed_at); returns the sources and the history rows to append."""
    j = sources.join(resets, "name", "left")
    out = j.withColumn("initial_weight", F.coalesce("new_weight", "initial_weight")).withColumn(
        "weight", F.coalesce("new_weight", "weight")).select(*sources.columns)
    history = resets.join(sources.select("name"), "name", "left_semi").select(
        "name", F.col("new_weight").alias("weight"), "changed_at", "reason")
    return out, history


def mean_weight(sources: DataFrame, default: float = 0.5) -> float:
    """Mean current weight of all sources (one number, so it is safe on the driver)."""
    v = sources.agg(F.avg("weight")).first()[0]
    return default if v is None else float(v)
