"""Calendar columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def epoch(ts: Column) -> Column:
    """Seconds since 1970 with the fraction kept."""
    return F.unix_micros(ts) / F.lit(1e6)


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)


def add_minutes(ts: Column, minutes: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.round(minutes * F.lit(6e7)).cast("long"))


def time_of_day(ts: Column) -> Column:
    h = F.hour(ts)
    return (
        F.when(h.between(5, 11), "Morning").when(h.between(12, 16), "Day")
        .when(h.between(17, 21), "Evening").otherwise("Night")
    )


def season(ts: Column) -> Column:
    m = F.month(ts)
    return (
        F.when(m.between(3, 5), "Spring").when(m.between(6, 8), "Summer")
        .when(m.between(9, 11), "Autumn").otherwise("Winter")
    )


def day_name(ts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), F.dayofweek(ts))


def local_hour(ts: Column, offset_hours: int) -> Column:
    return F.hour(F.timestamp_micros(F.unix_micros(ts) + F.lit(offset_hours * 3_600_000_000)))


def period_bounds(kind: str, today: dt.date) -> tuple[dt.datetime, dt.datetime]:
    """Bounds of a report: ``today`` alone, or with the 7 (week) or 30 (month) days before it."""
    back = {"day": 0, "week": 7, "month": 30}[kind]
    midnight = dt.datetime.combine(today, dt.time())
    return midnight - dt.timedelta(days=back), midnight + dt.timedelta(days=1, seconds=-1)
