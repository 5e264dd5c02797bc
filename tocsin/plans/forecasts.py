"""Forecast jobs: open incidents in, FORECAST rows out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from tocsin.functions.geo import KM_PER_DEGREE, destination
from tocsin.functions.rules import clamp01
from tocsin.functions.timeparts import add_minutes, epoch
from tocsin.operators import paths as P
from tocsin.operators.gazetteer import find_terms
from tocsin.operators.messages import active, top_per
from tocsin.operators.ordered import previous_row
from tocsin.operators.profiles import lifetime
from tocsin.operators.scan import heads, sector_scan
from tocsin.operators.spatial import (
    coordinates, corridor_samples, nearest_place, place_lookup, within_radius,
)
from tocsin.schemas import FORECAST
from tocsin.session import cut_lineage
from tocsin.settings import LIMITS, Limits

RECON_TYPES = ["Recon", "Shark"]


@dataclass
class Inputs:
    """Tables a forecast reads. ``past_*`` is the history the statistics come from."""

    incidents: DataFrame
    points: DataFrame
    places: DataFrame
    past_incidents: DataFrame | None = None
    past_points: DataFrame | None = None
    weight: float = 0.5
    limits: Limits = field(default_factory=lambda: LIMITS)

    def __post_init__(self):
        self.past_incidents = self.past_incidents if self.past_incidents is not None else self.incidents
        self.past_points = self.past_points if self.past_points is not None else self.points

    def open_points(self, open_incidents: DataFrame) -> DataFrame:
        return self.points.join(open_incidents.select("incident_id"), "incident_id", "left_semi")


def _finish(df: DataFrame, predictor: str) -> DataFrame:
    return df.withColumn("predictor", F.lit(predictor)).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in FORECAST])


def _box(df: DataFrame, width_km: Column, lo_lat="_la1", hi_lat="_la2", lo_lon="_lo1", hi_lon="_lo2"):
    d = width_km / KM_PER_DEGREE / 2
    return df.withColumns({"min_lat": F.col(lo_lat) - d, "max_lat": F.col(hi_lat) + d,
                           "min_lon": F.col(lo_lon) - d, "max_lon": F.col(hi_lon) + d})


_CORNERS = lambda: [F.min("lat").alias("_la1"), F.max("lat").alias("_la2"),
                    F.min("lon").alias("_lo1"), F.max("lon").alias("_lo2")]


def radius_km(speed: Column, hours: Column) -> Column:
    """Half of the distance covered until the window ends, within 2..50 km; 5 km without a speed."""
    return F.when(speed > 0, F.greatest(F.lit(2.0), F.least(F.lit(50.0), speed * hours * 0.5))).otherwise(5.0)


def bayes(x: Inputs) -> DataFrame:
    """Sector-scan candidates weighted by how likely their place is entered; recon types apart."""
    return _bayes_scan(x).unionByName(_bayes_recon(x))


def _bayes_scan(x: Inputs) -> DataFrame:
    inc = active(x.incidents).where(~F.col("type").isin(RECON_TYPES))
    cand = sector_scan(x.open_points(inc), x.places, 3, x.limits)
    w = P.incoming_weights(P.transitions(x.past_points))
    seen = x.past_incidents.select("type").distinct().withColumn("_seen", F.lit(True))
    c = cand.join(w.withColumnRenamed("weight", "_in"), ["type", "place"], "left").join(seen, "type", "left")
    factor = F.coalesce("_in", F.when(F.col("_seen"), 0.5).otherwise(1.0))
    c = c.withColumn("score", F.col("weight") * factor)
    g = c.groupBy("incident_id", "type").agg(
        F.sum("score").alias("_total"), F.max("score").alias("_best"),
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "rank", "place"))).alias("_p"),
        *_CORNERS()).where(F.col("_total") > 0)
    g = _box(g.join(inc.select("incident_id", "last_seen"), "incident_id"), F.lit(5.0))
    return _finish(g.select(
        "*", F.transform("_p", lambda p: p["place"]).alias("places"),
        (F.col("_best") / F.col("_total")).alias("confidence"),
        add_minutes(F.col("last_seen"), F.lit(5.0)).alias("window_start"),
        add_minutes(F.col("last_seen"), lifetime(F.col("type"), x.limits)).alias("window_end"),
        F.col("last_seen").alias("created_at")), "Bayesian")


def recon_hits(points: DataFrame, places: DataFrame, km: float) -> tuple[DataFrame, DataFrame]:
    """(samples of each path, distinct coordinates of places within ``km`` of a sample)."""
    s = previous_row(points, ["incident_id"], "ts", ["event_id"], ["lat", "lon"])
    samples = corridor_samples(s, "incident_id")
    hits = within_radius(samples, places, "slat", "slon", km).select(
        "incident_id", F.col("plat").alias("lat"), F.col("plon").alias("lon")).distinct()
    return samples, hits


def _bayes_recon(x: Inputs) -> DataFrame:
    inc = active(x.incidents).where(F.col("type").isin(RECON_TYPES))
    pts = x.open_points(inc)
    km = x.limits.recon_radius_km
    samples, hits = recon_hits(pts, x.places, km)
    spots = coordinates(x.places, 3).select("lat", "lon", "firsts")
    near = hits.join(spots, ["lat", "lon"]).select("incident_id", F.explode("firsts").alias("p"))
    firsts = top_per(near, ["incident_id"], [F.col("p.place_id")], 3).groupBy("incident_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("p.name").alias("n")))).alias("_p"))
    centre = samples.groupBy("incident_id").agg(F.avg("slat").alias("_clat"))
    box = pts.groupBy("incident_id").agg(*_CORNERS())
    g = firsts.join(centre, "incident_id").join(box, "incident_id").join(
        inc.select("incident_id", "type", "last_seen"), "incident_id")
    dlat = F.lit(km / KM_PER_DEGREE)
    dlon = km / (KM_PER_DEGREE * F.cos(F.radians("_clat")))
    return _finish(g.select(
        "incident_id", "type", F.transform("_p", lambda p: p["n"]).alias("places"),
        add_minutes(F.col("last_seen"), F.lit(5.0)).alias("window_start"),
        add_minutes(F.col("last_seen"), lifetime(F.col("type"), x.limits)).alias("window_end"),
        F.lit(0.7).alias("confidence"),
        (F.col("_la1") - dlat).alias("min_lat"), (F.col("_la2") + dlat).alias("max_lat"),
        (F.col("_lo1") - dlon).alias("min_lon"), (F.col("_lo2") + dlon).alias("max_lon"),
        F.col("last_seen").alias("created_at")), "Bayesian")


def statistical(x: Inputs) -> DataFrame:
    """Most frequent continuations of the last step and of the last two steps."""
    feats = P.features(x.points, active(x.incidents).where("n_points >= 2")).select(
        "incident_id", "tod", "dow", "avg_speed", "n_points", "last_seen")
    stats = cut_lineage(P.direction_stats(x.past_points, x.weight), "directions")
    cols = ["n", "prob", "avg_km", "avg_weight"]
    key = F.concat_ws("->", "k1", "k2", "k3")
    single = top_per(stats.withColumn("_key", key), ["type", "k1"], [F.desc("prob"), F.asc("_key")], 3)
    double = top_per(stats.where("k3 IS NOT NULL").withColumn("_key", key), ["type", "k1", "k2"],
                     [F.desc("prob"), F.asc("_key")], 2)
    inc = active(x.incidents).where("n_points >= 2")
    h = heads(x.open_points(inc)).select(
        "incident_id", "type", F.col("last.place").alias("_last"), F.col("before.place").alias("_before"))
    h = cut_lineage(h.join(feats, "incident_id"), "heads")
    tgt = F.coalesce("k3", "k2").alias("target")
    s = single.select("type", F.col("k1").alias("_last"), "_key", tgt, *cols,
                      F.lit(0).alias("_kind"), F.col("rank").alias("_r"))
    d = double.select("type", F.col("k1").alias("_before"), F.col("k2").alias("_last"), "_key", tgt, *cols,
                      F.lit(1).alias("_kind"), F.col("rank").alias("_r"))
    c = h.join(s, ["type", "_last"]).unionByName(
        h.where("n_points >= 3").join(d, ["type", "_before", "_last"]))
    tp = P.time_pattern(x.past_incidents).select("type", "tod", "dow", F.col("prob").alias("_tp"))
    c = c.join(tp, ["type", "tod", "dow"], "left").withColumn("_tp", F.coalesce("_tp", F.lit(0.1)))
    hours = F.try_divide(F.col("avg_km"), F.col("avg_speed"))
    win = x.limits.attack_window_min / 60.0
    moving = (F.col("avg_km") > 0) & (F.col("avg_speed") > 0)
    factor = F.when(moving & (hours > 2 * win), 0.3).when(moving & (hours > win), 0.7).otherwise(1.0)
    c = c.withColumn("score", F.round(F.col("prob") * F.col("_tp") * factor * F.col("avg_weight"), 12))
    best = top_per(c, ["incident_id"], [F.desc("score"), F.asc("_kind"), F.asc("_r")], 3)
    g = best.groupBy("incident_id", "type", "last_seen", "avg_speed", "n_points").agg(
        F.array_sort(F.collect_list(F.struct("rank", "target"))).alias("_p"),
        F.max(F.when(F.col("rank") == 1, F.struct("prob", "_tp", "avg_weight"))).alias("_b"))
    g = g.withColumn("places", F.array_distinct(F.transform("_p", lambda p: p["target"])))
    conf = clamp01(0.4 * F.col("_b.prob") + 0.2 * F.col("_b._tp") + 0.2 * F.col("_b.avg_weight")
                   + 0.2 * F.least(F.lit(1.0), F.col("n_points") / 5.0))
    g = _named_box(g, x.places, radius_km(F.col("avg_speed"), F.lit(win)))
    return _finish(g.select(
        "*", conf.alias("confidence"),
        add_minutes(F.col("last_seen"), F.lit(15.0)).alias("window_start"),
        add_minutes(F.col("last_seen"), F.lit(x.limits.attack_window_min)).alias("window_end"),
        F.col("last_seen").alias("created_at")), "Statistical")


def _named_box(g: DataFrame, places: DataFrame, width_km: Column) -> DataFrame:
    """Box around the places named in ``places``; null corners where none is a known place."""
    named = place_lookup(g.select("incident_id", F.explode("places").alias("place")), places, "place")
    corners = named.groupBy("incident_id").agg(*_CORNERS())
    return _box(g.join(corners, "incident_id", "left"), width_km)


def match_nodes(open_feats: DataFrame, points: DataFrame, nodes: DataFrame) -> DataFrame:
    """(incident_id, node_id, tier): type and region; type and a region naming one of the incident's
    places; type; for unknown types the most frequent node. Earlier nodes win inside a tier."""
    pick = lambda: F.min(F.struct("first_rank", "node_id"))["node_id"].alias("node_id")
    by_region = nodes.groupBy("type", "region_key").agg(pick())
    f = open_feats.select("incident_id", "type", "region_key")
    f = cut_lineage(f.join(by_region, ["type", "region_key"], "left"), "matched")
    t1 = f.where("node_id IS NOT NULL").select("incident_id", "node_id", F.lit(1).alias("tier"))
    rest = f.where("node_id IS NULL").drop("node_id")
    if rest.isEmpty():
        return t1

    pts = points.join(rest.select("incident_id"), "incident_id", "left_semi").select(
        "incident_id", "type", F.lower("place").alias("_p")).distinct()
    regions = nodes.select("region_key", F.lower("region_key").alias("_rk")).distinct()
    pairs = find_terms(regions, pts.select("_p").distinct().withColumn("_t", F.col("_p")),
                       "region_key", "_rk", "_p", "_t", gram=1)
    by_place = nodes.join(pairs, "region_key").groupBy("type", "_p").agg(
        F.min(F.struct("first_rank", "node_id")).alias("_n"))
    t2 = pts.join(by_place, ["type", "_p"]).groupBy("incident_id").agg(
        F.min("_n")["node_id"].alias("node_id"), F.lit(2).alias("tier"))
    rest = rest.join(t2.select("incident_id"), "incident_id", "left_anti")

    t3 = rest.join(nodes.groupBy("type").agg(pick()), "type").select(
        "incident_id", "node_id", F.lit(3).alias("tier"))
    rest = rest.join(t3.select("incident_id"), "incident_id", "left_anti")
    common = nodes.agg(F.min(F.struct((-F.col("n")).alias("o"), "first_rank", "node_id"))["node_id"]
                       .alias("node_id")).scalar()
    t4 = rest.where(F.col("type") == "Unknown").select("incident_id", common.alias("node_id"),
                                                       F.lit(4).alias("tier"))
    return t1.unionByName(t2).unionByName(t3).unionByName(t4)


def best_edges(edges: DataFrame, min_count: int, k: int = 3) -> DataFrame:
    """Top edges per node by probability decayed over 7 days since the last transition.

    Only the order matters, so the decay is taken in logarithms without a reference time.
    """
    rating = F.round(F.log("prob") + epoch(F.col("last_time")) / 86_400 / 7.0, 9)
    return top_per(edges.where(F.col("n") >= min_count).withColumn("_o", rating), ["src"],
                   [F.desc("_o"), F.asc("dst")], k)


def graph_model(points: DataFrame, incidents: DataFrame, weight: float = 0.5):
    """(features, nodes, edges). Features and edge rows feed several aggregates: each is written once."""
    feats = cut_lineage(P.features(points, incidents), "features")
    rows = cut_lineage(P.edge_rows(feats), "edge-rows")
    return feats, cut_lineage(P.graph_nodes(feats, weight), "nodes"), P.graph_edges(rows)


def graph(x: Inputs) -> DataFrame:
    """Follow the strongest edges of the node the incident belongs to."""
    past, nodes, edges = graph_model(x.past_points, x.past_incidents, x.weight)
    edges = best_edges(edges, x.limits.edge_min_count)
    same = x.past_points is x.points and x.past_incidents is x.incidents
    feats = active(past if same else P.features(x.points, x.incidents)).where("n_points >= 2")
    at = match_nodes(feats, x.points, nodes)
    target = nodes.select(F.col("node_id").alias("dst"), F.col("region_key").alias("_region"))
    hop = at.join(edges.withColumnRenamed("src", "node_id"), "node_id").join(target, "dst")
    g = hop.groupBy("incident_id", "node_id").agg(
        F.avg("prob").alias("_prob"),
        F.max(F.when(F.col("rank") == 1, F.struct("delay_mean", "delay_dev"))).alias("_e"),
        F.array_sort(F.collect_list(F.struct("rank", "_region"))).alias("_p"))
    names = F.flatten(F.transform("_p", lambda p: F.split(p["_region"], ",")))
    names = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")
    g = g.withColumn("places", names)
    g = g.join(feats.select("incident_id", "type", "avg_speed", "n_points", "last_seen"), "incident_id")
    g = g.join(nodes.select("node_id", "weight"), "node_id")
    dev = F.greatest(F.col("_e.delay_dev"), F.lit(0.5))
    g = g.withColumn("_from_h", F.greatest(F.col("_e.delay_mean") - dev, F.lit(0.25))).withColumn(
        "_to_h", F.col("_e.delay_mean") + dev)
    g = _named_box(g, x.places, radius_km(F.col("avg_speed"), F.col("_to_h")))
    conf = clamp01(0.5 * F.col("_prob") + 0.3 * F.col("weight")
                   + 0.2 * F.least(F.lit(1.0), F.col("n_points") / 5.0))
    return _finish(g.select(
        "*", conf.alias("confidence"),
        add_minutes(F.col("last_seen"), F.col("_from_h") * 60).alias("window_start"),
        add_minutes(F.col("last_seen"), F.col("_to_h") * 60).alias("window_end"),
        F.col("last_seen").alias("created_at")), "Graph")


def trajectory(x: Inputs) -> DataFrame:
    """Project the recent track along its heading; the place nearest to the projected point."""
    lim = x.limits
    inc = active(x.incidents).where("n_points >= 2")
    t = P.speed_stats(x.open_points(inc)).where(F.col("speed") >= 0.1)
    km = F.least(F.col("speed") * (lim.attack_window_min / 60.0), F.lit(lim.forecast_max_km))
    t = t.withColumn("km", km).withColumn("_h", F.col("km") / F.col("speed"))
    la, lo = destination(F.col("lat"), F.col("lon"), F.col("bearing"), F.col("km"))
    t = t.withColumn("_la1", la).withColumn("_lo1", lo)
    t = nearest_place(t, x.places, "_la1", "_lo1")
    u = lim.uncertainty
    conf = clamp01(0.5 + 0.2 * F.least(F.lit(1.0), F.col("n_track") / 5.0) + 0.15 * F.col("stability")
                   + F.when(F.col("name").isNotNull(), 0.1).otherwise(0.0))
    half = F.when(F.col("km") * u < 0.1, 1.0).otherwise(F.col("km") * u)
    t = _box(t, half * 2, "_la1", "_la1", "_lo1", "_lo1")
    spot = F.format_string("(%.4f, %.4f)", "_la1", "_lo1")
    return _finish(t.join(inc.select("incident_id", "last_seen"), "incident_id").select(
        "*", F.array(F.coalesce("name", spot)).alias("places"), conf.alias("confidence"),
        add_minutes(F.col("ts"), F.col("_h") * 60 * (1 - u)).alias("window_start"),
        add_minutes(F.col("ts"), F.col("_h") * 60 * (1 + u)).alias("window_end"),
        F.col("last_seen").alias("created_at")), "Trajectory")


#: plug-in registry: name -> function(Inputs) -> FORECAST rows
PREDICTORS: dict[str, Callable[[Inputs], DataFrame]] = {
    "Bayesian": bayes, "Graph": graph, "Statistical": statistical, "Trajectory": trajectory,
}


def forecast(x: Inputs, enabled: list[str] | None = None) -> DataFrame:
    """Union of the enabled predictors. The incidents, which each reads several times, are written once."""
    incidents = cut_lineage(x.incidents, "incidents")
    x = replace(x, incidents=incidents,
                past_incidents=incidents if x.past_incidents is x.incidents else x.past_incidents)
    out = None
    for name in enabled or list(PREDICTORS):
        f = PREDICTORS[name](x)
        out = f if out is None else out.unionByName(f)
    return out


#: fixed values: weights of the combined vote
VOTE_WEIGHTS = {"Graph": 0.4, "Statistical": 0.3, "Trajectory": 0.3}


def vote(forecasts: DataFrame, weights: dict[str, float] | None = None, k: int = 3) -> DataFrame:
    """(incident_id, rank, place, score): places by the weighted confidence of the predictors naming them."""
    w = weights or VOTE_WEIGHTS
    table = F.create_map(*[F.lit(v) for item in w.items() for v in item])
    rows = forecasts.where(F.col("predictor").isin(list(w))).select(
        "incident_id", F.explode(F.array_distinct("places")).alias("place"),
        (table[F.col("predictor")] * F.col("confidence")).alias("_s"))
    g = rows.groupBy("incident_id", "place").agg(F.round(F.sum("_s"), 9).alias("score"))
    return top_per(g, ["incident_id"], [F.desc("score"), F.asc("place")], k)
