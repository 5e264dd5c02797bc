"""Sector scan around the last point of an incident."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tocsin.functions.geo import angle_gap, bearing_deg
from tocsin.operators.messages import top_per
from tocsin.operators.paths import last_points
from tocsin.operators.profiles import max_distance
from tocsin.operators.spatial import distance_weight, nearest_in_sector, sector_weights
from tocsin.settings import LIMITS, Limits


def heads(points: DataFrame) -> DataFrame:
    """Last and last-but-one point of each incident with the heading between them."""
    item = F.struct("place", "lat", "lon", "ts")
    g = last_points(points, 2).groupBy("incident_id", "type").agg(
        F.max(F.when(F.col("rank") == 1, item)).alias("last"),
        F.max(F.when(F.col("rank") == 2, item)).alias("before"))
    head = bearing_deg(F.col("before.lat"), F.col("before.lon"), F.col("last.lat"), F.col("last.lon"))
    return g.withColumn("heading", head)


def sector_scan(points: DataFrame, places: DataFrame, k: int = 3, limits: Limits = LIMITS) -> DataFrame:
    """(incident_id, type, rank, place, lat, lon, sector, dist, weight): the k best next places.

    Distances are evaluated once per distinct origin coordinate and limit; incidents then look up
    their origin's 72 sector weights and the nearest places, and only the heading bonus is computed
    per incident.
    """
    h = heads(points).select(
        "incident_id", "type", "heading", F.col("last.lat").alias("lat0"),
        F.col("last.lon").alias("lon0")).withColumn("max_km", max_distance(F.col("type"), limits))
    origins = h.select("lat0", "lon0", "max_km").distinct()
    weights = sector_weights(origins, places).groupBy("lat0", "lon0", "max_km").agg(
        F.map_from_entries(F.collect_list(F.struct("sector", "weight"))).alias("_w"))
    near = nearest_in_sector(h.select("lat0", "lon0").distinct(), places, 3).where(~F.col("is_admin"))
    near = near.groupBy("lat0", "lon0", "sector").agg(F.array_sort(F.collect_list(
        F.struct("rank", "name", "lat", "lon", "dist"))).alias("_n"))
    near = near.groupBy("lat0", "lon0").agg(
        F.map_from_entries(F.collect_list(F.struct("sector", "_n"))).alias("_near"))
    j = h.join(weights, ["lat0", "lon0", "max_km"], "left").join(near, ["lat0", "lon0"], "left")
    toward = lambda s: F.when(angle_gap(s.cast("double"), F.col("heading")) <= 30, 2.0).otherwise(0.0)
    rated = F.transform(F.sequence(F.lit(0), F.lit(355), F.lit(5)), lambda s: F.struct(
        (-(F.coalesce(F.try_element_at("_w", s), F.lit(0.0)) + toward(s))).alias("o"), s.alias("sector")))
    best = F.slice(F.array_sort(rated), 1, k)
    hit = j.select("incident_id", "type", "max_km", "_near",
                   F.posexplode(F.transform(best, lambda x: x["sector"])).alias("_pos", "sector"))
    hit = hit.select("incident_id", "type", "max_km", "_pos", "sector",
                     F.explode(F.try_element_at("_near", F.col("sector"))).alias("c"))
    hit = hit.select("incident_id", "type", "_pos", "sector", "c.*",
                     distance_weight(F.col("c.dist"), F.col("max_km")).alias("_cw"))
    g = hit.groupBy("incident_id", "type", F.col("name").alias("place")).agg(
        F.sum("_cw").alias("weight"), F.min("dist").alias("dist"),
        F.min_by("sector", "_pos").alias("sector"), F.min("lat").alias("lat"),
        F.min("lon").alias("lon"))
    return top_per(g, ["incident_id"], [F.desc("weight"), F.asc("dist"), F.asc("place")], k)
