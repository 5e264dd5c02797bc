"""Limits per type as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tocsin.operators.sizing import checked_broadcast
from tocsin.settings import LIMITS, Limits


def _lookup(type_: Column, index: int, default: float, limits: Limits) -> Column:
    pairs = [F.lit(x) for t, p in limits.profiles.items() for x in (t, float(p[index]))]
    return F.coalesce(F.create_map(*pairs)[type_], F.lit(float(default)))


def max_speed(type_: Column, limits: Limits = LIMITS) -> Column:
    return _lookup(type_, 0, limits.default_profile[0], limits)


def max_distance(type_: Column, limits: Limits = LIMITS) -> Column:
    return _lookup(type_, 1, limits.default_profile[1], limits)


def lifetime(type_: Column, limits: Limits = LIMITS) -> Column:
    return _lookup(type_, 2, limits.default_profile[2], limits)


def expiry(type_: Column, limits: Limits = LIMITS) -> Column:
    """Idle minutes after which an incident expires: unlisted types live longer than they match."""
    return _lookup(type_, 2, limits.default_expiry_min, limits)


def join_profiles(df: DataFrame, profiles: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Attach a profile table (type, max_speed_kmh, max_distance_km, lifetime_min) with defaults."""
    speed, dist, life = limits.default_profile
    j = df.join(checked_broadcast(profiles), "type", "left")
    return j.withColumns({
        "max_speed_kmh": F.coalesce("max_speed_kmh", F.lit(speed)),
        "max_distance_km": F.coalesce("max_distance_km", F.lit(dist)),
        "lifetime_min": F.coalesce("lifetime_min", F.lit(life)),
    })
