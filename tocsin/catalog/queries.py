"""Registered queries: each runs one operator over the whole test tables of a folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tocsin import fixtures as X
from tocsin.functions import rules as R, text as TX
from tocsin.functions.geo import box_geojson
from tocsin.operators import (
    context as C, dedup as D, gazetteer as G, incidents as I, messages as M, paths as P, reports as RP,
    scan as SC, spatial as S,
)
from tocsin.operators.profiles import join_profiles, max_distance
from tocsin.plans import forecasts as FC
from tocsin.session import cut_lineage, scratch_dir
from tocsin.settings import LIMITS
from tocsin.sources import archive as A, tables as TB
from tocsin.streaming import jobs as J, live as LV

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c) -> F.Column:
    return F.round(c, 6)


def us(c: str) -> F.Column:
    return F.unix_micros(c)


def csv(c) -> F.Column:
    return F.array_join(c, ",")


# --- transitions and directions ---------------------------------------------------------------------

@query
def transition_probability(spark, d):
    t = P.transitions(X.points(spark, d))
    return t.select("type", "from_place", "to_place", "n", r6("prob").alias("prob"))


@query
def incoming_weight(spark, d):
    return P.incoming_weights(P.transitions(X.points(spark, d))).select(
        "type", "place", r6("weight").alias("weight"))


@query
def incoming_weight_from(spark, d):
    return P.incoming_weights_from(P.transitions(X.points(spark, d))).select(
        "type", "from_place", "place", r6("weight").alias("weight"))


@query
def direction_stats(spark, d):
    s = P.direction_stats(X.points(spark, d))
    return s.select("type", F.concat_ws("->", "k1", "k2", "k3").alias("direction"), "n",
                    r6("prob").alias("prob"), r6("avg_km").alias("avg_km"), "avg_weight")


@query
def chain_stats(spark, d):
    c = P.chains(X.points(spark, d))
    return c.groupBy("type", "k1", "k2", "k3").agg(F.count("*").alias("n"), r6(F.avg("km")).alias("km"))


@query
def time_pattern(spark, d):
    t = P.time_pattern(P.rollup(X.points(spark, d)))
    return t.select("type", "tod", "dow", "n", r6("prob").alias("prob"))


# --- incidents, features, graph -----------------------------------------------------------------------

@query
def incident_rollup(spark, d):
    i = P.rollup(X.points(spark, d))
    return i.select("incident_id", "type", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"),
                    "status", r6("confidence").alias("confidence"), "n_points", "has_recon",
                    us("recon_time").alias("recon_us"))


@query
def point_dedupe(spark, d):
    p = P.distinct_points(X.points(spark, d))
    return p.select("incident_id", "place", "event_id", us("ts").alias("ts_us"))


@query
def incident_features(spark, d):
    pts = X.points(spark, d)
    f = P.features(pts, P.rollup(pts))
    return f.select("incident_id", "type", "tod", "season", "dow", "has_recon", "n_points", "n_places",
                    r6("path_km").alias("path_km"), r6("avg_speed").alias("avg_speed"), "speed_bin",
                    "region", "region_key")


@query
def graph_nodes(spark, d):
    pts = X.points(spark, d)
    n = P.graph_nodes(P.features(pts, P.rollup(pts)))
    return n.select("node_id", "n", "weight", F.col("first_rank.incident_id").alias("first_incident"),
                    r6("avg_speed").alias("avg_speed"), r6("path_km").alias("path_km"), "n_points")


def _edge_rows(spark, d):
    pts = X.points(spark, d)
    feats = cut_lineage(P.features(pts, P.rollup(pts)), "features")
    return cut_lineage(P.edge_rows(feats), "edge-rows")


@query
def graph_edges(spark, d):
    pts = X.points(spark, d)
    *_, e = FC.graph_model(pts, P.rollup(pts))
    return e.select("src", "dst", "n", r6("prob").alias("prob"), r6("delay_mean").alias("delay_mean"),
                    r6("delay_dev").alias("delay_dev"), r6("km_mean").alias("km_mean"),
                    us("last_time").alias("last_us"))


@query
def edge_deviation(spark, d):
    rows = _edge_rows(spark, d)
    coarse = rows.withColumn("src", F.substring_index("src", "|", 1)).withColumn(
        "dst", F.substring_index("dst", "|", 1))
    return P.delay_deviation(coarse).select("src", "dst", r6("delay_dev").alias("delay_dev"))


@query
def zone_build(spark, d):
    z = P.zones(X.points(spark, d), max_distance(F.col("type")))
    return z.select("incident_id", "type", r6("center_lat").alias("center_lat"),
                    r6("center_lon").alias("center_lon"), r6("radius_km").alias("radius_km"), "n")


@query
def zone_update(spark, d):
    pts = X.points(spark, d)
    first = pts.where("event_id % 2 = 0")
    later = pts.where("event_id % 2 = 1").withColumn("batch", F.col("event_id"))
    z = P.update_zones(first, later, max_distance(F.col("type")))
    return z.select("incident_id", r6("center_lat").alias("center_lat"),
                    r6("radius_km").alias("radius_km"), "n", "weight")


@query
def profile_limits(spark, d):
    prof = spark.createDataFrame([(k, *v) for k, v in LIMITS.profiles.items()],
                                 "type string, max_speed_kmh double, max_distance_km double, lifetime_min double")
    i = P.rollup(X.points(spark, d)).groupBy("type").agg(F.count("*").alias("n"))
    return join_profiles(i, prof)


# --- spatial ---------------------------------------------------------------------------------------------

@query
def pair_distance(spark, d):
    s = P.steps(X.points(spark, d)).where("prev IS NOT NULL")
    pairs = s.select(F.col("prev.place").alias("from_name"), F.col("place").alias("to_name")).distinct()
    r = S.pair_distance(pairs, X.places(spark, d))
    return r.select("from_name", "to_name", r6("dist_km").alias("dist_km"), r6("azimuth").alias("azimuth"))


@query
def nearest_k(spark, d):
    p = X.places(spark, d)
    n = S.nearest_k(S.origins_of(X.points(spark, d), "lat", "lon"), p, 5)
    return n.select(r6("lat0").alias("lat0"), r6("lon0").alias("lon0"), "rank", "place_id",
                    r6("dist").alias("dist"), r6("azimuth").alias("azimuth"))


@query
def nearest_in_sector(spark, d):
    p = X.places(spark, d)
    n = S.nearest_in_sector(S.origins_of(X.points(spark, d), "lat", "lon"), p, 3)
    return n.select(r6("lat0").alias("lat0"), r6("lon0").alias("lon0"), "sector", "rank", "place_id",
                    r6("dist").alias("dist"))


@query
def sector_scan(spark, d):
    s = SC.sector_scan(X.points(spark, d), X.places(spark, d))
    return s.select("incident_id", "rank", "place", r6("dist").alias("dist"), "weight")


@query
def radius_places(spark, d):
    h = SC.heads(X.points(spark, d)).select("incident_id", F.col("last.lat").alias("la"),
                                            F.col("last.lon").alias("lo"))
    w = S.within_radius(h, X.places(spark, d), "la", "lo", 7.0)
    return S.attach_places(w, X.places(spark, d)).select("incident_id", "place_id", r6("dist").alias("dist"))


@query
def corridor_places(spark, d):
    _, hits = FC.recon_hits(X.points(spark, d), X.places(spark, d), 7.0)
    return S.attach_places(hits.select("incident_id", F.col("lat").alias("plat"), F.col("lon").alias("plon")),
                           X.places(spark, d)).select("incident_id", "place_id")


@query
def box_places(spark, d):
    b = X.points(spark, d).groupBy("incident_id").agg(
        (F.min("lat") - 0.05).alias("min_lat"), (F.max("lat") + 0.05).alias("max_lat"),
        (F.min("lon") - 0.05).alias("min_lon"), (F.max("lon") + 0.05).alias("max_lon"))
    b = b.select("incident_id", *[F.round(c, 4).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])
    p = X.places(spark, d)
    p = p.withColumn("lat", F.round("lat", 4)).withColumn("lon", F.round("lon", 4))
    return S.places_in_boxes(b, p, totals=1e-4).select("incident_id", "n", "first_place")


@query
def speed_stats(spark, d):
    s = P.speed_stats(X.points(spark, d))
    return s.select("incident_id", "n_track", *[r6(c).alias(c) for c in (
        "mean_speed", "speed_dev", "speed", "stability", "bearing")])


# --- forecasts ----------------------------------------------------------------------------------------------

def _inputs(spark, d, min_count=1) -> FC.Inputs:
    pts = X.points(spark, d)
    return FC.Inputs(incidents=P.rollup(pts), points=pts, places=X.places(spark, d),
                     limits=replace(LIMITS, edge_min_count=min_count))


def _forecast_out(f: DataFrame) -> DataFrame:
    return f.select("incident_id", "type", csv("places").alias("places"),
                    us("window_start").alias("start_us"), us("window_end").alias("end_us"),
                    r6("confidence").alias("confidence"),
                    *[r6(c).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])


@query
def bayes_forecast(spark, d):
    return _forecast_out(FC._bayes_scan(_inputs(spark, d)))


@query
def recon_forecast(spark, d):
    return _forecast_out(FC._bayes_recon(_inputs(spark, d)))


def _to_seconds(f: DataFrame) -> DataFrame:
    """Windows computed from fractional hours are compared to the second."""
    sec = lambda c: F.round(F.col(c) / 1e6).cast("long")
    return f.withColumn("start_s", sec("start_us")).withColumn("end_s", sec("end_us")).drop(
        "start_us", "end_us")


@query
def stat_forecast(spark, d):
    return _forecast_out(FC.statistical(_inputs(spark, d)))


@query
def graph_forecast(spark, d):
    return _to_seconds(_forecast_out(FC.graph(_inputs(spark, d))))


@query
def graph_forecast_default(spark, d):
    """With the product's least number of transitions."""
    return _to_seconds(_forecast_out(FC.graph(_inputs(spark, d, min_count=LIMITS.edge_min_count))))


@query
def trajectory_forecast(spark, d):
    return _to_seconds(_forecast_out(FC.trajectory(_inputs(spark, d))))


def _forecasts(spark, d) -> DataFrame:
    x = _inputs(spark, d)
    return FC.forecast(x, ["Graph", "Statistical", "Trajectory"])


@query
def vote_forecast(spark, d):
    return FC.vote(_forecasts(spark, d)).select("incident_id", "rank", "place", r6("score").alias("score"))


@query
def predictor_agreement(spark, d):
    return RP.agreement(_forecasts(spark, d)).select("compared", "matched", r6("pct").alias("pct"))


@query
def agreement_detail(spark, d):
    r = RP.agreement_rows(_forecasts(spark, d), "Statistical", "Trajectory")
    return r.select("incident_id", r6("overlap").alias("overlap"))


@query
def report_predictors(spark, d):
    return RP.by_predictor(_forecasts(spark, d)).select(
        "predictor", "n", r6("avg_confidence").alias("avg_confidence"))


@query
def forecast_period(spark, d):
    x = _inputs(spark, d)
    f = RP.forecasts_in_period(FC.statistical(x), x.incidents, dt.datetime(2024, 1, 10),
                               dt.datetime(2024, 1, 20))
    return f.select("incident_id", us("created_at").alias("created_us"), r6("confidence").alias("confidence"))


@query
def alert_forecasts(spark, d):
    a = M.alerts(FC.trajectory(_inputs(spark, d)), LIMITS.alert_confidence)
    return a.select("incident_id", r6("confidence").alias("confidence"))


@query
def zone_geojson(spark, d):
    b = X.points(spark, d).groupBy("incident_id").agg(
        *[F.round(f(c), 2).alias(f"{n}_{c}") for f, n in ((F.min, "lo"), (F.max, "hi")) for c in ("lat", "lon")])
    return b.select("incident_id", box_geojson(F.col("lo_lat"), F.col("hi_lat"), F.col("lo_lon"),
                                               F.col("hi_lon")).alias("zone"))


# --- reports ------------------------------------------------------------------------------------------------------

@query
def report_types(spark, d):
    return RP.by_type(P.rollup(X.points(spark, d))).select("type", "n", r6("pct").alias("pct"))


@query
def report_hours(spark, d):
    return RP.top_hours(P.rollup(X.points(spark, d)), 3, 3)


@query
def report_places(spark, d):
    return RP.top_places(X.points(spark, d))


@query
def report_endpoints(spark, d):
    return RP.top_endpoints(X.points(spark, d))


@query
def report_transitions(spark, d):
    return RP.top_steps(X.points(spark, d))


@query
def report_summary(spark, d):
    s = RP.summary(P.rollup(X.points(spark, d)))
    return s.select("n", r6("avg_confidence").alias("avg_confidence"), "n_terminated",
                    r6("pct_terminated").alias("pct_terminated"))


@query
def report_week(spark, d):
    """All incident sections of one week's report as one table."""
    pts = X.points(spark, d)
    r = RP.report(P.rollup(pts), pts, None, dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 14, 23, 59, 59))
    parts = {"types": r["types"].select(F.col("type").alias("item"), "n"),
             "hours": r["hours"].select(F.col("hour").cast("string").alias("item"), "n"),
             "places": r["places"].select(F.col("place").alias("item"), "n"),
             "endpoints": r["endpoints"].select(F.col("place").alias("item"), "n"),
             "steps": r["steps"].select(F.concat_ws(">", "from_place", "to_place").alias("item"), "n"),
             "summary": r["summary"].select(F.lit("terminated").alias("item"), F.col("n_terminated").alias("n"))}
    out = None
    for name, t in parts.items():
        t = t.select(F.lit(name).alias("section"), "item", "n")
        out = t if out is None else out.unionByName(t)
    return out


@query
def active_incidents(spark, d):
    return M.active(P.rollup(X.points(spark, d))).select("incident_id", "status")


@query
def expired_incidents(spark, d):
    i = I.expire_incidents(P.rollup(X.points(spark, d)), "2024-01-30 22:00:00")
    return i.groupBy("type", "status").agg(F.count("*").alias("n"))


@query
def incident_override(spark, d):
    i = P.rollup(X.points(spark, d))
    o = i.where("n_points >= 5").select("incident_id", F.lit("Terminated").alias("new_status"),
                                        F.lit("closed by hand").alias("reason"))
    return I.override_incidents(i, o).select("incident_id", "status", "reason")


@query
def latest_incident_point(spark, d):
    p = M.latest_per(X.points(spark, d), ["incident_id"], "ts", ["event_id"])
    return p.select("incident_id", "event_id", "place")


@query
def latest_points(spark, d):
    return X.points(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select(
        "event_id", us("ts").alias("ts_us"), "place")


# --- message classification ---------------------------------------------------------------------------------------------

def _classified(spark, d) -> DataFrame:
    return M.classify(X.documents(spark, d), "text", X.TERMS)


@query
def priority_class(spark, d):
    return _classified(spark, d).select("message_id", "priority")


@query
def type_class(spark, d):
    return _classified(spark, d).select("message_id", "type", "category")


@query
def status_flags(spark, d):
    return _classified(spark, d).select("message_id", "status", csv("flags").alias("flags"))


@query
def clear_type_class(spark, d):
    rules = [(t, r) for t, r in X.TERMS["types"] if r]
    return X.documents(spark, d).select("message_id", R.clear_type(F.col("text"), rules).alias("clear_type"))


def _parsed(spark, d) -> DataFrame:
    """Documents as parsed messages: places from the term gazetteer, no direction."""
    docs = _classified(spark, d)
    found = G.extract_places(docs, X.terms(spark, d), "message_id", "text", F.lower, TX.plain_words)
    empty = F.array().cast("array<struct<name:string,lat:double,lon:double>>")
    return docs.join(found, "message_id", "left").withColumn("places", F.coalesce("places", empty)) \
        .withColumn("direction", F.lit(None).cast("string"))


@query
def place_mentions(spark, d):
    found = G.extract_places(X.documents(spark, d), X.terms(spark, d), "message_id", "text", F.lower,
                             TX.plain_words)
    return found.select("message_id", F.size("places").cast("long").alias("n"),
                        csv(F.array_sort(F.transform("places", lambda p: p["name"]))).alias("names"),
                        F.length(F.col("places")[0]["name"]).cast("long").alias("longest"))


@query
def place_mentions_indexed(spark, d):
    """The same job through the gram index, as for a gazetteer too large to broadcast."""
    found = G.extract_places(X.documents(spark, d), X.terms(spark, d), "message_id", "text", F.lower,
                             TX.plain_words, scan_rows=0)
    return found.select("message_id", F.size("places").cast("long").alias("n"),
                        csv(F.array_sort(F.transform("places", lambda p: p["name"]))).alias("names"))


@query
def word_places(spark, d):
    t = X.documents(spark, d)
    return G.word_places(t, X.terms(spark, d), "message_id", "text").groupBy("message_id").agg(
        F.count("*").alias("n"), F.min("name").alias("first_name"))


@query
def best_place(spark, d):
    """Best gazetteer entry for each sentence of the benchmark texts."""
    b = X.table(spark, d, "benchmark")
    ph = b.select(F.explode(F.split(F.lower("text"), r"[.,!?\n]+")).alias("phrase")).select(
        F.trim("phrase").alias("phrase")).where("length(phrase) > 0").distinct()
    return G.best_place(ph, X.terms(spark, d), "phrase", F.lower).select("phrase", F.col("place.name").alias("name"))


@query
def admin_places(spark, d):
    return X.table(spark, d, "part").select(
        "p_partkey", S.is_administrative(F.concat(F.col("p_name"), F.when(F.col("p_size") % 3 == 0, " район")
                                                  .when(F.col("p_size") % 3 == 1, " МО").otherwise("мост"))).alias("is_admin"))


@query
def confidence_score(spark, d):
    return M.score(_parsed(spark, d)).select("message_id", r6("confidence").alias("confidence"),
                                             csv("flags").alias("flags"))


@query
def message_route(spark, d):
    return M.route(M.score(_parsed(spark, d))).groupBy("route", "status").agg(F.count("*").alias("n"))


@query
def sender_filter(spark, d):
    f = M.filter_senders(X.documents(spark, d), ["SRC1", "src2"], ["rc12", "src20"])
    return f.select("message_id", "sender")


@query
def channel_filter(spark, d):
    return M.filter_channels(X.documents(spark, d), ["SRC3", "src7"]).select("message_id", "sender")


@query
def nonblank_messages(spark, d):
    docs = X.documents(spark, d)
    halves = docs.withColumn("text", F.explode(F.split("text", "\n")))
    return M.drop_blank(halves).groupBy("message_id").agg(F.count("*").alias("n"))


@query
def priority_order(spark, d):
    return _classified(spark, d).orderBy("priority", "ts", "message_id").select("priority", "message_id")


@query
def clean_text(spark, d):
    return X.documents(spark, d).select("message_id", F.md5(TX.clean_message(F.col("text"))).alias("digest"))


@query
def token_counts(spark, d):
    t = TX.tokens(F.col("text"), ["and", "the", "und"], 2)
    return X.documents(spark, d).select("message_id", F.size(t).cast("long").alias("n"),
                                        F.md5(csv(F.array_sort(t))).alias("digest"))


@query
def payload_text(spark, d):
    c = TX.payload_text(F.col("text"), 120)
    return X.documents(spark, d).select("message_id", F.octet_length(c).cast("long").alias("n_bytes"),
                                        F.md5(c).alias("digest"))


@query
def abbreviations(spark, d):
    table = {"the": "THE-LONG", "der": "DER-LANG"}
    c = TX.expand_abbreviations(F.col("text"), table)
    return X.documents(spark, d).select("message_id", F.md5(c).alias("digest"))


# --- duplicates -------------------------------------------------------------------------------------------------------------

@query
def exact_dups(spark, d):
    return D.exact_duplicates(X.documents(spark, d), "message_id", "text")


@query
def near_dup_pairs(spark, d):
    return D.near_pairs(X.documents(spark, d), "message_id", "text", ["lang"], "ts").select(
        "message_id", "earlier_id", r6("similarity").alias("similarity"))


@query
def retained_messages(spark, d):
    return D.retained(X.documents(spark, d), "message_id", "text", "lang", "ts").select(
        "message_id", "duplicate_of", r6("similarity").alias("similarity"))


@query
def bigram_jaccard(spark, d):
    return D.neighbour_jaccard(X.chats(spark, d), ["chat"], "ts", ["message_id"], "message_id", "text").select(
        "message_id", "earlier_id", r6("jaccard").alias("jaccard"))


@query
def compact_messages(spark, d):
    """Insert-or-replace: every text stored under its hash, the newest message wins."""
    m = X.documents(spark, d).withColumn("hash", TX.text_hash(F.col("text")))
    return M.latest_per(m, ["hash"], "ts", ["message_id"]).select("hash", "message_id", "sender")


# --- context --------------------------------------------------------------------------------------------------------------------

@query
def reply_context(spark, d):
    r = C.reply_context(X.chats(spark, d))
    return r.select("message_id", "type", F.size("places").cast("long").alias("n_places"),
                    r6("confidence").alias("confidence"), csv("flags").alias("flags"))


def _simple(m):
    return C.token_context(m, ["chat"])


def _tfidf(m):
    return C.tfidf_context(m, ["chat"])


@query
def token_context(spark, d):
    return _simple(X.chats(spark, d)).select("message_id", "context_id", r6("score").alias("score"))


@query
def tfidf_context(spark, d):
    return _tfidf(X.chats(spark, d)).select("message_id", "context_id", r6("score").alias("score"))


@query
def ensemble_context(spark, d):
    m = X.chats(spark, d)
    return C.combined_context(_simple(m), _tfidf(m), m)


@query
def context_applied(spark, d):
    m = X.chats(spark, d)
    r = C.apply_context(m, _simple(m))
    return r.select("message_id", "type", r6("confidence").alias("confidence"), csv("flags").alias("flags"))


# --- sources ----------------------------------------------------------------------------------------------------------------------

def _labelled(spark, d) -> DataFrame:
    lab = X.table(spark, d, "labels").select(F.col("doc_id").alias("message_id"),
                                             (F.col("quality") == 1).alias("confirmed"))
    return X.documents(spark, d).join(lab, "message_id")


@query
def source_reliability(spark, d):
    w = P.source_weights(_labelled(spark, d))
    return w.select("name", "total", "n_confirmed", r6("weight").alias("weight"))


@query
def source_history(spark, d):
    h = P.source_history(_labelled(spark, d), "ts", ["message_id"])
    return h.select("sender", "message_id", "total", "n_confirmed", r6("weight").alias("weight"))


@query
def source_adjusted(spark, d):
    w = P.source_weights(_labelled(spark, d))
    m = M.weigh_by_source(M.score(_parsed(spark, d)), w)
    return m.select("message_id", r6("source_weight").alias("source_weight"), r6("confidence").alias("confidence"))


def _sources(spark, d) -> DataFrame:
    return P.source_weights(_labelled(spark, d)).select("name", "initial_weight", "weight")


@query
def source_reset(spark, d):
    src = _sources(spark, d)
    new = X.table(spark, d, "documents").select(F.concat("source", F.lit("-x")).alias("name")).distinct() \
        .withColumn("initial_weight", F.lit(0.7)).withColumn("weight", F.lit(0.7))
    both = P.initialise_sources(src, new.unionByName(src.withColumn("weight", F.lit(0.0))))
    resets = src.where("name like '%1'").select("name", F.lit(0.9).alias("new_weight"),
                                                F.lit("manual").alias("reason"),
                                                F.lit(X.BASE).cast("timestamp").alias("changed_at"))
    out, _ = P.reset_sources(both, resets)
    return out.select("name", r6("initial_weight").alias("initial_weight"), r6("weight").alias("weight"))


@query
def place_upsert(spark, d):
    p = X.places(spark, d)
    new = p.where("place_id % 4 = 0").select(
        (F.col("place_id") + 1_000_000).alias("place_id"),
        F.when(F.col("place_id") % 8 == 0, F.col("name")).otherwise(F.concat("name", F.lit("-new"))).alias("name"),
        (F.col("lat") + 1).alias("lat"), "lon", F.lit(X.BASE).cast("timestamp").alias("changed_at"))
    return TB.upsert_places(p, new).select("place_id", "name", r6("lat").alias("lat"), r6("lon").alias("lon"))


# --- incidents from messages ---------------------------------------------------------------------------------------------------------

@query
def incident_assign(spark, d):
    a = I.assign(X.sightings(spark, d))
    return a.select("scope", "message_id", "root", "action", "status", r6("confidence").alias("confidence"))


@query
def incident_table(spark, d):
    t = I.incident_table(I.assign(X.sightings(spark, d)), "2024-01-31 00:00:00")
    return t.select("scope", "root", "type", "category", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "status",
                    r6("confidence").alias("confidence"), "has_recon", us("recon_time").alias("recon_us"), "n_messages")


@query
def linked_incidents(spark, d):
    return I.linked(X.sightings(spark, d)).select("scope", "type", "message_id", "place", "link_no")


@query
def session_incidents(spark, d):
    s = I.sessions(X.sightings(spark, d))
    return s.select("scope", "type", us("start").alias("start_us"), us("end").alias("end_us"), "n")


def _clears(spark, d) -> DataFrame:
    return X.table(spark, d, "events").where("event_type = 'error'").select(
        F.floor(F.col("user_id") / 10).cast("long").alias("scope"), X.type_of(F.col("user_id")).alias("type"),
        F.col("ts").alias("clear_ts"), F.col("event_id").alias("clear_id"))


def _scoped(spark, d) -> DataFrame:
    return P.rollup(X.points(spark, d)).withColumn(
        "scope", F.floor(F.col("incident_id") / 1_000_000).cast("long"))


@query
def all_clear_typed(spark, d):
    i = M.active(_scoped(spark, d)).select("incident_id", "scope", "type", "last_seen")
    c = I.closed_by_type(i, _clears(spark, d).select("scope", "type", "clear_ts"))
    return c.where("closed_at IS NOT NULL").select("incident_id", us("closed_at").alias("closed_us"))


@query
def all_clear_latest(spark, d):
    i = M.active(_scoped(spark, d)).select("incident_id", "scope", "last_seen")
    return I.closed_latest(i, _clears(spark, d).select("scope", "clear_ts", "clear_id"))


@query
def all_clear_place(spark, d):
    """All-clears that name a place; each closes the oldest incident that is open then and was seen there."""
    pts = X.points(spark, d)
    i = M.active(_scoped(spark, d)).select("incident_id", "scope", "type", "first_seen", "last_seen")
    c = _clears(spark, d).join(pts.select(F.col("event_id").alias("clear_id"), "place"), "clear_id")
    return I.closed_oldest(i, pts.select("incident_id", "place", "ts"), c.select("scope", "clear_ts", "clear_id", "place"))


@query
def auto_close(spark, d):
    pts = X.points(spark, d)
    inc = M.active(P.rollup(pts))
    first = pts.groupBy("incident_id").agg(F.min_by("place", F.struct("ts", "event_id")).alias("place"))
    clears = pts.where("mark = 'Terminated'").select("place", F.col("ts").alias("clear_ts"))
    return I.closed_by_place(inc, first, clears)


# --- archives and payloads -----------------------------------------------------------------------------------------------------------------

def _archive(spark, d) -> DataFrame:
    """Conversations as archive documents: their texts as strings, arrays of strings and objects, or arrays of
    objects; every eleventh turn is blank."""
    c = X.table(spark, d, "conversations")
    t = F.col("turn")
    listed = F.to_json(F.array("text"))  # ["..."]
    as_object = lambda c: F.to_json(F.struct(F.col(c).alias("text")))
    as_text = F.when(t % 11 == 10, F.lit('" "')) \
        .when(t % 3 == 0, F.substring(listed, F.lit(2), F.length(listed) - 2)) \
        .when(t % 3 == 1, F.concat(F.lit('["turn",'), as_object("text"), F.lit(',{"type":"x"}]'))) \
        .otherwise(F.concat(F.lit("["), as_object("role"), F.lit(","), as_object("text"), F.lit("]")))
    secs = F.unix_seconds(F.lit(X.BASE).cast("timestamp")) + F.col("conv_id") * 3600 + t * 45
    iso = F.date_format(F.timestamp_seconds(secs), "yyyy-MM-dd'T'HH:mm:ss")
    msg = F.struct(
        (F.col("conv_id") * 1000 + t).alias("id"),
        F.when(t % 5 == 4, F.lit("no date")).otherwise(iso).alias("date"),
        F.when(t % 2 == 0, secs.cast("string")).otherwise(F.lit("0")).alias("date_unixtime"),
        F.when(t % 4 == 0, F.col("role")).alias("from"),
        F.when(t > 0, F.col("conv_id") * 1000 + t - 1).alias("reply_to_message_id"),
        F.parse_json(as_text).alias("text"))
    return c.groupBy("conv_id").agg(F.collect_list(msg).alias("messages")).select(
        F.concat(F.lit("chat "), F.col("conv_id").cast("string")).alias("name"), "messages")


@query
def archive_flatten(spark, d):
    a = A.flatten_archive(_archive(spark, d))
    return a.select("message_id", "sender", "text", us("received_at").alias("received_us"), "reply_to", "rejected")


@query
def archive_quality(spark, d):
    q = A.quality(A.flatten_archive(_archive(spark, d)))
    return q.select("total", "kept", "no_date", us("first_time").alias("first_us"), us("last_time").alias("last_us"))


@query
def archive_hours(spark, d):
    return A.busiest_hours(A.flatten_archive(_archive(spark, d)))


@query
def archive_edges(spark, d):
    e = A.edge_times(A.flatten_archive(_archive(spark, d)))
    return e.select("side", "message_id", us("received_at").alias("received_us"))


@query
def payload_json(spark, d):
    s = X.sightings(spark, d)
    p = TB.payload(F.col("ts"), F.concat(F.lit("channel "), F.col("scope").cast("string")), F.col("type"),
                   F.col("category"), F.transform("places", lambda x: x["name"]), F.lit(None).cast("string"),
                   F.col("status"), F.col("confidence"), F.concat(F.lit("message number "), F.col("message_id").cast("string")))
    return s.select("message_id", p.alias("payload"))


# --- streams: run to completion over the table, as available now --------------------------------------------------------------------------------

def _event_stream(spark, d) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    s = J.message_stream(spark, f"{d}/events*.parquet", schema)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query
def hourly_counts(spark, d):
    g = X.table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return g.select(us("w.start").alias("hour_us"), "n")


@query
def stream_first_ids(spark, d):
    s = _event_stream(spark, d).select(
        F.lit("feed").alias("source_type"), (F.col("event_id") % 5000).cast("string").alias("message_id"),
        F.lit(X.BASE).cast("timestamp").alias("received_at"))
    return J.run_available(J.first_seen_ids(s), "first-ids").groupBy("source_type").agg(F.count("*").alias("n"))


@query
def stream_first_texts(spark, d):
    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    s = J.message_stream(spark, f"{d}/documents*.parquet", schema).select(
        "lang", "text", F.lit(X.BASE).cast("timestamp").alias("received_at"))
    return J.run_available(J.first_seen_texts(s, "lang", "text", "received_at"), "first-texts").groupBy(
        "lang").agg(F.count("*").alias("n"), F.countDistinct("hash").alias("n_hashes"))


def _slices(df, ts: str, folder: str, parts: list) -> str:
    """Write the rows of each condition as files of their own, one condition after the other: a feed in that order."""
    for p in parts:
        df.where(p).write.mode("append").parquet(folder)
    return folder


def _assigned_stream(spark, d) -> DataFrame:
    s = cut_lineage(X.sightings(spark, d), "sightings")
    mid = F.lit(dt.datetime(2024, 1, 15))
    feed = _slices(s, "ts", scratch_dir(spark, "feed"), [F.col("ts") < mid, F.col("ts") >= mid])
    return J.run_available(J.assign_stream(J.message_stream(spark, feed, s.schema)), "assigned")


@query
def stream_assign(spark, d):
    """Sightings fed as a stream through the stateful assignment."""
    a = _assigned_stream(spark, d).where("action <> 'expired'")
    return a.select("scope", "message_id", "root", "action", "status", r6("confidence").alias("confidence"))


@query
def stream_expired(spark, d):
    """Incidents that ran out while the stream went on, with the time."""
    a = _assigned_stream(spark, d).where("action = 'expired'")
    return a.select("scope", "root", "type", us("ts").alias("expired_us"), r6("confidence").alias("confidence"))


WEEK = 604_800
#: rows of a slice of the live feed from which it is written as several files
SLICE_FILE_ROWS = 50_000


def _live(spark, d) -> str:
    """Run the live flow over a feed of weekly slices in which every 37th message comes a slice late."""
    s = X.sightings(spark, d).withColumn("_w", LV.period(F.col("ts"), WEEK))
    s = cut_lineage(s, "feed-rows")
    low, high = s.agg(F.min("_w"), F.max("_w")).first()
    weeks = range(low or 0, (high or 0) + 1, WEEK)
    slice_ = F.col("_w") + F.when((F.col("message_id") % 37 == 0) & (F.col("_w") < high), WEEK).otherwise(0)
    plain = s.withColumn("_s", slice_).drop("_w")
    feed, root = scratch_dir(spark, "feed"), scratch_dir(spark, "live")
    # every slice has the same number of files, so that a micro-batch is one slice and many tasks write and read it
    n = max(1, (plain.groupBy("_s").count().agg(F.min("count")).first()[0] or 0) // SLICE_FILE_ROWS)
    for w in weeks:
        rows = plain.where(F.col("_s") == w).drop("_s")
        (rows.repartition(n) if n > 1 else rows.coalesce(1)).write.mode("append").parquet(feed)
    LV.run_live(spark, feed, s.drop("_w").schema, root, every_s=WEEK, maxFilesPerTrigger=n)
    return root


@query
def live_late(spark, d):
    root = _live(spark, d)
    flag = lambda name, late: LV.read(spark, root, name).select("scope", "message_id", F.lit(late).alias("late"))
    return flag("main", False).unionByName(flag("late", True))


@query
def live_rerun(spark, d):
    """Main and late rows assigned again: as if all had come in time."""
    a = LV.rerun(spark, _live(spark, d))
    return a.select("scope", "message_id", "root", "action", "status", r6("confidence").alias("confidence"))


@query
def live_alerts(spark, d):
    a = LV.read(spark, _live(spark, d), "alerts")
    return a.select("scope", "message_id", "root", "version", "place", csv("next_places").alias("next_places"),
                    r6("confidence").alias("confidence"), "payload")
