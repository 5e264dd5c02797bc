"""First-match rule tables as ``when`` chains, and the columns built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tocsin import settings as S


def any_of(low: Column, terms) -> Column:
    """True if the lower-case text contains any term; a tuple of terms must all be contained."""
    tests = [
        reduce(lambda a, b: a & b, [low.contains(p) for p in t]) if isinstance(t, tuple)
        else low.contains(t)
        for t in terms
    ]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def first_match(low: Column, rules, default) -> Column:
    """Result of the first rule (terms, result) that hits."""
    chain = None
    for terms, result in rules:
        terms = terms if isinstance(terms, list) else [terms]
        test = any_of(low, terms)
        chain = F.when(test, F.lit(result)) if chain is None else chain.when(test, F.lit(result))
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def priority_class(text: Column, rules=None) -> Column:
    return first_match(F.lower(text), rules or S.PRIORITY_TERMS, S.LOWEST_PRIORITY)


def event_type(text: Column, type_terms=None, fibre_terms=None) -> Column:
    """Ordered keyword classification; a keyword without a type stops the search as Unknown."""
    rules = [(fibre_terms if fibre_terms is not None else S.FIBRE_TERMS, "FpvFiberOptic")]
    rules += [([t], r or "Unknown") for t, r in (type_terms or S.TYPE_TERMS)]
    return first_match(F.lower(text), rules, "Unknown")


def event_category(text: Column, type_: Column, drone_types=None, weather_terms=None) -> Column:
    return (
        F.when(type_ == "FpvFiberOptic", "Drone").when(type_ == "Rocket", "Missile")
        .when(type_.isin(drone_types or S.DRONE_TYPES), "Drone")
        .when(any_of(F.lower(text), weather_terms or S.WEATHER_TERMS), "Weather")
        .otherwise("Unknown")
    )


def clear_type(text: Column, rules=None) -> Column:
    """Type named by an all-clear without places; null when it names none."""
    return first_match(F.lower(text), [([t], r) for t, r in (rules or S.CLEAR_TYPE_TERMS)], None)


def status(text: Column, clear_terms=None, watch_terms=None) -> Column:
    low = F.lower(text)
    return (
        F.when(any_of(low, [t for t, _ in (clear_terms or S.CLEAR_TERMS)]), "Terminated")
        .when(any_of(low, watch_terms or S.WATCH_TERMS), "Watch").otherwise("Active")
    )


def flags(text: Column, clear_terms=None, flag_terms=None) -> Column:
    """Array of flags. Destroyed depends on the first clear term that hits, in list order."""
    low = F.lower(text)
    destroyed = first_match(low, [([t], d) for t, d in (clear_terms or S.CLEAR_TERMS)], False)
    marks = [F.when(destroyed, F.lit("Destroyed"))]
    marks += [F.when(any_of(low, terms), F.lit(f)) for f, terms in (flag_terms or S.FLAG_TERMS)]
    return F.array_compact(F.array(*marks))


def confidence(n_places: Column, type_: Column, direction: Column, status_: Column) -> Column:
    """Base confidence; without a place it is capped at 0.3."""
    raw = (
        F.lit(0.4)
        + F.when(n_places > 0, F.least(F.lit(0.3), n_places * 0.1)).otherwise(-0.1)
        + F.when(type_ != "Unknown", 0.2).otherwise(0.0)
        + F.when(F.coalesce(direction, F.lit("")) != "", 0.1).otherwise(0.0)
        + F.when(status_ == "Active", 0.05).otherwise(0.0)
    )
    return F.when(n_places == 0, F.least(clamp01(raw), F.lit(0.3))).otherwise(clamp01(raw))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def weighted_confidence(conf: Column, weight: Column) -> Column:
    """Confidence scaled by the reliability of the source."""
    return clamp01(conf * (0.5 + 0.5 * weight))
