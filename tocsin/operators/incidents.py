"""Messages to incidents.

``assign`` reproduces the order-dependent greedy matching: each message may change what the next one
sees. ``linked`` is the shuffle-friendly variant in which a message continues the sighting just before
it. Both take the SIGHTING columns of ``tocsin.schemas``.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tocsin.functions.geo import haversine_km
from tocsin.operators import ordered
from tocsin.operators.ordered import first_after, previous_row, running_totals
from tocsin.operators.profiles import expiry, lifetime, max_distance, max_speed
from tocsin.operators.replay import replay
from tocsin.session import cut_lineage
from tocsin.settings import LIMITS, Limits

PLACES = "array<struct<name:string,lat:double,lon:double>>"
ASSIGNED = (
    "scope long, message_id long, ts timestamp, type string, category string, root long, "
    f"action string, status string, confidence double, added {PLACES}, removed_name string, "
    "removed_ts timestamp, recon boolean"
)


def _km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p1, p2 = math.radians(lat1), math.radians(lat2)
    h = (math.sin((p2 - p1) / 2) ** 2
         + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2)
    return 12742.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


class OpenIncidents:
    """Open incidents of one scope; messages must arrive in time order.

    The state holds open incidents only: anything idle longer than its lifetime is dropped, so its
    size follows the traffic of the longest lifetime, not the length of the stream.
    """

    def __init__(self, limits: Limits = LIMITS, dump: str | None = None):
        self.limits = limits
        self.items: dict[int, dict] = {i["root"]: i for i in json.loads(dump)} if dump else {}
        self.gone: list[dict] = []  # what the last message found expired

    def dump(self) -> str:
        return json.dumps([self.items[k] for k in sorted(self.items)], ensure_ascii=False)

    def step(self, row) -> list[dict]:
        return self.process(message_dict(row)) or [{"action": "none"}]

    def due(self, inc: dict) -> float:
        """When an incident expires unless it is seen again."""
        return inc["seen"] + self.limits.expiry_min(inc["type"]) * 60

    def expire(self, now: float) -> list[dict]:
        gone = [i for i in self.items.values()
                if now - i["seen"] > self.limits.expiry_min(i["type"]) * 60]
        for i in gone:
            del self.items[i["root"]]
        return gone

    def _oldest_first(self) -> list[dict]:
        return sorted(self.items.values(), key=lambda i: (i["first"], i["root"]))

    def _close(self, inc: dict, action: str) -> dict:
        del self.items[inc["root"]]
        inc["status"] = "Terminated"
        return {"root": inc["root"], "action": action, "status": "Terminated",
                "confidence": inc["conf"], "added": []}

    def _clear(self, m: dict) -> list[dict]:
        if m["places"]:
            named = {p["name"].lower() for p in m["places"]}
            for inc in self._oldest_first():
                if named & {n.lower() for n in inc["names"]}:
                    return [self._close(inc, "closed_by_place")]
            return []
        wanted = m.get("clear_type")
        if wanted:
            same = lambda i: wanted.lower() in (i["type"].lower(), (i["category"] or "").lower())
            return [self._close(i, "closed_by_type") for i in self._oldest_first() if same(i)]
        recent = [i for i in self.items.values() if m["t"] - i["seen"] < 1800]
        if not recent:
            return []
        latest = min(recent, key=lambda i: (-i["seen"], i["first"], i["root"]))
        return [self._close(latest, "closed_latest")]

    def _reach(self, inc: dict, m: dict) -> tuple[bool, bool]:
        """(same object, far jump) of a message against an incident."""
        speed, most, life = self.limits.profile(m["type"])
        last = max(enumerate(inc["points"]), key=lambda x: (x[1]["t"], x[0]))[1]
        to = m["places"][0]
        km = _km(last["lat"], last["lon"], to["lat"], to["lon"])
        minutes = (m["t"] - inc["seen"]) / 60
        travel = speed * (minutes / 60) * 1.05
        far = most < km <= travel
        if minutes < 0.1:
            return km <= min(most * 0.3, 15.0) + 3.0, far
        return km <= travel and km <= most + 3.0 and minutes <= life, far

    def process(self, m: dict) -> list[dict]:
        """Rows caused by message ``m``: t, id, type, category, status, places, confidence, ..."""
        self.gone = self.expire(m["t"])
        if m["status"] == "Terminated":
            return self._clear(m)
        if not m["places"]:
            return []
        typed = m["type"] and m["type"] != "Unknown"
        match, far = None, False
        for inc in self._oldest_first():
            if typed and inc["type"].lower() != m["type"].lower():
                continue
            same, far = self._reach(inc, m)
            if same or far:
                match = inc
                break
        action = "far" if match and far else "same" if match else "new"
        if match is None:
            far = False
            match = {"root": m["id"], "type": m["type"], "category": m.get("category"), "first": m["t"],
                     "seen": m["t"], "status": "Active", "conf": m.get("confidence") or 0.0,
                     "points": [], "names": []}
            self.items[m["id"]] = match
        removed = None
        if far:
            at = max(enumerate(match["points"]), key=lambda x: (x[1]["t"], x[0]))[0]
            removed = match["points"].pop(at)
            if removed["name"] in match["names"]:
                match["names"].remove(removed["name"])
        added = []
        for p in m["places"]:
            known = not far and any(
                q["name"].lower() == p["name"].lower() and abs(q["lat"] - p["lat"]) < 1e-4
                and abs(q["lon"] - p["lon"]) < 1e-4 for q in match["points"])
            if known:
                continue
            match["points"].append({"name": p["name"], "lat": p["lat"], "lon": p["lon"], "t": m["t"]})
            added.append(p)
            if p["name"] not in match["names"]:
                match["names"].append(p["name"])
        match["seen"] = max(q["t"] for q in match["points"])
        match["first"] = min(q["t"] for q in match["points"])
        watch = m["status"] == "Watch"
        if watch:
            match["status"] = "Watch"
            match["conf"] += self.limits.watch_boost
        elif m.get("destroyed"):
            match["status"] = "Terminated"
        match["conf"] = min(1.0, match["conf"] + self.limits.located_boost)
        if match["status"] == "Terminated":
            self.items.pop(match["root"], None)
        return [{"root": match["root"], "action": action, "status": match["status"],
                 "confidence": match["conf"], "added": added,
                 "removed_name": removed["name"] if removed else None,
                 "removed_t": removed["t"] if removed else None, "recon": watch}]


def message_dict(r) -> dict:
    """A sighting row (named tuple) as the state machine reads it."""
    places = r.places if r.places is not None else []
    return {
        "id": int(r.message_id), "t": r.ts.value / 1e9 if hasattr(r.ts, "value") else r.ts.timestamp(),
        "type": r.type, "category": r.category, "status": r.status, "destroyed": bool(r.destroyed),
        "confidence": float(r.confidence), "clear_type": r.clear_type,
        "places": [dict(p) if isinstance(p, dict) else p.asDict() for p in places],
    }


def result_frame(rows: list[tuple]) -> pd.DataFrame:
    """(row, outcome) pairs as a frame of the ASSIGNED schema."""
    def at(t):
        return pd.NaT if t is None else pd.Timestamp(round(t * 1e6), unit="us")

    return pd.DataFrame({
        "scope": pd.array([r.scope for r, _ in rows], dtype="Int64"),
        "message_id": pd.array([r.message_id for r, _ in rows], dtype="Int64"),
        "ts": pd.Series([r.ts for r, _ in rows], dtype="datetime64[us]"),
        "type": pd.Series([r.type for r, _ in rows], dtype="object"),
        "category": pd.Series([r.category for r, _ in rows], dtype="object"),
        "root": pd.array([o.get("root") for _, o in rows], dtype="Int64"),
        "action": pd.Series([o["action"] for _, o in rows], dtype="object"),
        "status": pd.Series([o.get("status") for _, o in rows], dtype="object"),
        "confidence": pd.Series([o.get("confidence") for _, o in rows], dtype="float64"),
        "added": pd.Series([o.get("added", []) for _, o in rows], dtype="object"),
        "removed_name": pd.Series([o.get("removed_name") for _, o in rows], dtype="object"),
        "removed_ts": pd.Series([at(o.get("removed_t")) for _, o in rows], dtype="datetime64[us]"),
        "recon": pd.Series([bool(o.get("recon")) for _, o in rows], dtype="boolean"),
    })


def assign(sightings: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """One row per message and incident it touched (ASSIGNED schema); untouched messages get ``none``.

    Runs as a chunked replay: a day per chunk, warmed up over twice the longest lifetime. The state is
    the set of open incidents.
    """
    s = sightings if "clear_type" in sightings.columns else sightings.withColumn(
        "clear_type", F.lit(None).cast("string"))
    warm = int(limits.longest_expiry_min * 120)
    return replay(s, "scope", "ts", "message_id", 86_400, warm, ASSIGNED,
                  lambda dump: OpenIncidents(limits, dump), result_frame, "assign")


def incident_id():
    """Deterministic id: hash of the scope and the incident's first message."""
    return F.xxhash64("scope", "root")


def incident_table(assigned: DataFrame, as_of=None, limits: Limits = LIMITS) -> DataFrame:
    """Incidents from assignments; with ``as_of`` those idle past their lifetime become Expired.

    An incident is last seen at its latest point, as in the assignment itself: a message that repeats
    a known place adds no point and does not keep the incident open.
    """
    a = assigned.where("root IS NOT NULL").withColumn("incident_id", incident_id())
    order = F.struct("ts", "message_id")
    sight = F.col("action").isin("new", "same", "far")
    g = a.groupBy("incident_id", "scope").agg(
        F.min("root").alias("root"), F.min_by(F.when(sight, F.col("type")), order).alias("type"),
        F.min_by(F.when(sight, F.col("category")), order).alias("category"),
        F.min(F.when(sight, F.col("ts"))).alias("first_seen"),
        F.max(F.when(sight & (F.size("added") > 0), F.col("ts"))).alias("last_seen"),
        F.max_by("status", order).alias("status"), F.max_by("confidence", order).alias("confidence"),
        F.max("recon").alias("has_recon"),
        F.max(F.when(F.col("recon"), F.col("ts"))).alias("recon_time"),
        F.count_if(sight).alias("n_messages"))
    if as_of is not None:
        g = expire_incidents(g, as_of, limits)
    return g


def expire_incidents(incidents: DataFrame, as_of, limits: Limits = LIMITS) -> DataFrame:
    """Open incidents whose last sighting plus lifetime lies before ``as_of`` become Expired."""
    idle = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("last_seen")) / F.lit(6e7)
    late = F.col("status").isin("Active", "Watch") & (idle > expiry(F.col("type"), limits))
    return incidents.withColumn("status", F.when(late, "Expired").otherwise(F.col("status")))


def incident_points(assigned: DataFrame) -> DataFrame:
    """Points of all incidents (place, lat, lon, ts) without those a far jump removed."""
    a = assigned.where("root IS NOT NULL").withColumn("incident_id", incident_id())
    pts = a.select("incident_id", "type", "ts", "message_id",
                   F.posexplode("added").alias("pos", "p")).select(
        "incident_id", "type", "ts", F.col("message_id").alias("event_id"), "pos",
        F.col("p.name").alias("place"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))
    # a removal names the time of its point, so a place added again later keeps its own
    gone = a.where("removed_name IS NOT NULL").select(
        "incident_id", F.col("removed_name").alias("place"), F.col("removed_ts").alias("ts"))
    return pts.join(gone, ["incident_id", "place", "ts"], "left_anti")


def override_incidents(incidents: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual status changes (incident_id, new_status, reason); rows without one stay as they are."""
    j = incidents.join(overrides.select("incident_id", "new_status", "reason"), "incident_id", "left")
    return j.withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def same_object(km, minutes, type_, limits: Limits = LIMITS):
    """Can an object of the type be at ``km`` from its last point after ``minutes``?"""
    most = max_distance(type_, limits)
    strict = km <= F.least(most * 0.3, F.lit(15.0)) + 3.0
    travel = max_speed(type_, limits) * (minutes / 60) * 1.05
    normal = (km <= travel) & (km <= most + 3.0) & (minutes <= lifetime(type_, limits))
    return F.when(minutes < 0.1, strict).otherwise(normal)


def linked(sightings: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Chains of consecutive sightings of one (scope, type): link_no grows where the chain breaks.

    Needs no per-scope task: predecessor and numbering are bucketed scans.
    """
    s = sightings.where((F.size("places") > 0) & (F.col("status") != "Terminated"))
    s = s.select("scope", "type", "ts", "message_id", F.col("places")[0]["name"].alias("place"),
                 F.col("places")[0]["lat"].alias("lat"), F.col("places")[0]["lon"].alias("lon"))
    p = previous_row(s, ["scope", "type"], "ts", ["message_id"], ["ts", "lat", "lon"], "p")
    km = haversine_km(F.col("p.lat"), F.col("p.lon"), F.col("lat"), F.col("lon"))
    minutes = (F.unix_micros("ts") - F.unix_micros(F.col("p.ts"))) / F.lit(6e7)
    cont = F.col("p").isNotNull() & same_object(km, minutes, F.col("type"), limits)
    p = p.withColumn("_start", F.when(cont, 0).otherwise(1).cast("long")).drop("p")
    return running_totals(p, ["scope", "type"], "ts", ["message_id"], {"link_no": "_start"}).drop("_start")


def sessions(sightings: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Incidents by time alone: sightings of one (scope, type) chained while gaps stay within lifetime.

    A session ends when the lifetime of its last sighting is over; lifetimes count in whole minutes.
    """
    minutes = lifetime(F.col("type"), limits).cast("int")
    s = ordered.sessions(sightings, ["scope", "type"], "ts", minutes.cast("long") * 60_000_000)
    end = F.timestamp_micros(F.unix_micros("last") + minutes.cast("long") * 60_000_000)
    return s.select("scope", "type", "start", end.alias("end"), "n")


# --- closing, as joins over finished tables -----------------------------------------------------------------

def closed_by_type(incidents: DataFrame, clears: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Incidents with the first typed all-clear of their scope and type before they expire (closed_at)."""
    life = int(limits.longest_expiry_min * 60)
    f = first_after(incidents, clears, ["scope", "type"], "last_seen", "clear_ts", life, "closed_at")
    idle = (F.unix_micros("closed_at") - F.unix_micros("last_seen")) / F.lit(6e7)
    return f.withColumn("closed_at", F.when(idle <= expiry(F.col("type"), limits), F.col("closed_at")))


def closed_latest(incidents: DataFrame, clears: DataFrame, minutes: float = 30.0) -> DataFrame:
    """(clear_id, incident_id): an untyped all-clear closes the latest incident seen in the last 30 min."""
    life = int(minutes * 60)
    inc = incidents.select("scope", "incident_id", F.col("last_seen").alias("ts"),
                           F.lit(None).cast("long").alias("clear_id"))
    clr = clears.select("scope", F.lit(None).cast("long").alias("incident_id"),
                        F.col("clear_ts").alias("ts"), "clear_id")
    p = previous_incident(inc, clr, life)
    return p.where("incident_id IS NOT NULL")


def previous_incident(inc: DataFrame, clr: DataFrame, seconds: int) -> DataFrame:
    """As-of: for each clear the last incident row of the scope strictly within ``seconds`` before it."""
    from pyspark.sql import Window

    b = lambda: F.floor(F.unix_micros("ts") / F.lit(seconds * 1_000_000)).cast("long")
    item = F.struct("ts", "incident_id")
    i = inc.withColumn("_b", b()).withColumn("_i", item)
    nxt = i.groupBy("scope", "_b").agg(F.max("_i").alias("_i")).select(
        "scope", (F.col("_b") + 1).alias("_b"), "_i", F.col("_i.ts").alias("ts"),
        F.lit(None).cast("long").alias("clear_id"))
    both = (
        i.select("scope", "_b", "_i", "ts", "clear_id").unionByName(nxt)
        .unionByName(clr.withColumn("_b", b()).select(
            "scope", "_b", F.lit(None).cast("struct<ts:timestamp,incident_id:bigint>").alias("_i"),
            "ts", "clear_id"))
    )
    # at equal times incidents come before the clear
    w = Window.partitionBy("scope", "_b").orderBy(F.col("ts"), F.col("clear_id").asc_nulls_first()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    f = both.withColumn("_last", F.max("_i").over(w)).where("clear_id IS NOT NULL")
    age = F.unix_micros("ts") - F.unix_micros("_last.ts")
    return f.select("clear_id", F.when(age < seconds * 1_000_000, F.col("_last.incident_id"))
                    .alias("incident_id"))


def closed_oldest(incidents: DataFrame, points: DataFrame, clears: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """(clear_id, incident_id): an all-clear with places closes the oldest incident of its scope that is open at that
    time, was already seen at one of these places, and no earlier all-clear has closed.

    clears: scope, clear_ts, clear_id, place (a row for each place named); points: incident_id, place, ts. An incident
    is open from its first sighting until its last one plus its lifetime. Candidates come from one equi-join on scope, place and time bucket.
    They are then settled in rounds: a clear takes its oldest candidate once no earlier undecided clear
    could take that one. The earliest undecided clear of a scope always can, so every round decides some, and
    the outcome is that of going through the clears one after the other.
    """
    life = F.unix_micros("last_seen") + expiry(F.col("type"), limits) * 60_000_000
    width = int(limits.longest_expiry_min * 60) * 1_000_000
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    seen = points.groupBy("incident_id", F.lower("place").alias("_p")).agg(F.min("ts").alias("_from"))
    i = incidents.withColumn("_until", life.cast("long")).join(seen, "incident_id").select(
        "scope", "incident_id", "first_seen", "_until", "_from", "_p",
        F.explode(F.sequence(bucket(F.unix_micros("_from")), bucket(F.col("_until")))).alias("_b"))
    c = clears.select("scope", "clear_ts", "clear_id", F.lower("place").alias("_p"), bucket(F.unix_micros("clear_ts")).alias("_b"))
    cand = c.join(i, ["scope", "_p", "_b"]).where((F.col("_from") <= F.col("clear_ts")) & (F.unix_micros("clear_ts") <= F.col("_until")))
    clear, age = F.struct("clear_ts", "clear_id"), F.struct("first_seen", "incident_id")
    cand = cut_lineage(cand.select(clear.alias("c"), age.alias("i")).distinct(), "candidates")
    out = None
    while True:
        wish = cand.groupBy("c").agg(F.min("i").alias("i"))
        first = cand.groupBy("i").agg(F.min("c").alias("c"))
        done = cut_lineage(wish.join(first, ["c", "i"]), "closed")
        if done.isEmpty():
            break
        out = done if out is None else out.unionByName(done)
        cand = cut_lineage(cand.join(done.select("c"), "c", "left_anti").join(done.select("i"), "i", "left_anti"), "candidates")
    out = done if out is None else out
    return out.select("c.clear_id", "i.incident_id")


def closed_by_place(incidents: DataFrame, incident_places: DataFrame, clears: DataFrame,
                    hours: float = 1.0) -> DataFrame:
    """(incident_id): open incidents whose first place is named by an all-clear in
    [first_seen - 1 h, last_seen + 1 h].

    The all-clears are reduced to first and last time per (place, hour). The interval is two hours or
    longer, so it never starts and ends inside one hour and the reduced rows decide exactly.
    """
    width = int(hours * 3600)
    us = 1_000_000
    bucket = lambda c: F.floor(c / F.lit(width * us)).cast("long")
    c = clears.select("place", F.unix_micros("clear_ts").alias("_c")).groupBy(
        "place", bucket(F.col("_c")).alias("_b")).agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi"))
    i = incidents.join(incident_places.select("incident_id", "place"), "incident_id").select(
        "incident_id", "place", (F.unix_micros("first_seen") - width * us).alias("_s"),
        (F.unix_micros("last_seen") + width * us).alias("_e"))
    i = i.withColumn("_b", F.explode(F.sequence(bucket(F.col("_s")), bucket(F.col("_e")))))
    hit = i.join(c, ["place", "_b"]).where((F.col("_hi") >= F.col("_s")) & (F.col("_lo") <= F.col("_e")))
    return hit.select("incident_id").distinct()
