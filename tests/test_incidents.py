import datetime as dt
import random

import pytest

from tocsin.operators import incidents as I, paths as P, reports as RP
from tocsin.settings import LIMITS
from tocsin.streaming import jobs as J

SCHEMA = ("scope long, message_id long, ts timestamp, type string, category string, status string, destroyed boolean, "
          "confidence double, places array<struct<name:string,lat:double,lon:double>>, clear_type string")
A, B, C_, FAR = ("A", 50.0, 37.0), ("B", 50.1, 37.0), ("C", 50.2, 37.0), ("Far", 50.9, 37.0)


def msg(i, minute, typ="FPV", places=(A,), status="Active", clear=None, scope=1, cat="Drone"):
    return (scope, i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), typ, cat, status, False, 0.5,
            list(places), clear)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.message_id: (r.root, r.action) for r in I.assign(df).collect()}


def test_same_object_and_new(spark):
    got = run(spark, [msg(1, 0), msg(2, 10, places=[B]), msg(3, 11, places=[FAR]), msg(4, 60, places=[B])])
    assert got[2] == (1, "same")
    assert got[3] == (3, "new")       # 90 km in a minute
    assert got[4][1] == "new"         # thirty minutes of silence end an FPV incident


def test_strict_distance_for_simultaneous_reports(spark):
    got = run(spark, [msg(1, 0), msg(2, 0, places=[B]), msg(3, 0, places=[C_])])
    assert got[2] == (1, "same")      # 11 km <= 15 km
    assert got[3] == (1, "same")      # measured from B, the last point


def test_far_jump_replaces_last_point(spark):
    rows = [msg(1, 0), msg(2, 5, places=[B]), msg(3, 29, places=[("D", 50.55, 37.0)])]
    got = run(spark, rows)
    assert got[3] == (1, "far")
    pts = I.incident_points(I.assign(spark.createDataFrame(rows, SCHEMA)))
    assert [r.place for r in pts.orderBy("ts").collect()] == ["A", "D"]


def test_unknown_type_joins_the_oldest(spark):
    got = run(spark, [msg(1, 0, "FPV"), msg(2, 1, "Drone"), msg(3, 5, "Unknown", [B])])
    assert got[3] == (1, "same")
    assert got[2] == (2, "new")       # other type at the same place


def test_all_clears(spark):
    rows = [msg(1, 0), msg(2, 1, "Rocket", [C_]), msg(3, 2, "Drone", [FAR]),
            msg(4, 3, "Unknown", [C_], "Terminated"),            # shared place
            msg(5, 4, "Unknown", [], "Terminated", "FPV"),       # type
            msg(6, 5, "Unknown", [], "Terminated"),              # latest
            msg(7, 6, "Unknown", [], "Terminated")]              # nothing left
    got = run(spark, rows)
    assert got[4] == (2, "closed_by_place")
    assert got[5] == (1, "closed_by_type")
    assert got[6] == (3, "closed_latest")
    assert got[7] == (None, "none")


def test_category_all_clear_closes_all(spark):
    df = spark.createDataFrame([msg(1, 0), msg(2, 1, "StrikeDrone", [FAR]), msg(3, 2, "Unknown", [], "Terminated", "Drone")], SCHEMA)
    closed = I.assign(df).where("action = 'closed_by_type'").collect()
    assert {r.root for r in closed} == {1, 2}


def test_incident_table_confidence_and_expiry(spark):
    rows = [msg(1, 0), msg(2, 10, places=[B], status="Watch"), msg(3, 0, "Rocket", [FAR], scope=2)]
    t = I.incident_table(I.assign(spark.createDataFrame(rows, SCHEMA)), "2024-01-01 00:30:00")
    r = {x.type: x for x in t.collect()}
    assert r["FPV"].status == "Watch" and r["FPV"].confidence == pytest.approx(0.5 + 0.1 + 0.2 + 0.1)
    assert r["FPV"].has_recon and r["Rocket"].status == "Expired"


def test_table_and_assignment_agree_on_expiry(spark):
    df = spark.createDataFrame([msg(1, 0), msg(2, 20), msg(3, 40)], SCHEMA)  # the same place each time: one point
    a = I.assign(df)
    assert {r.message_id: r.action for r in a.collect()}[3] == "new"
    t = {r.first_seen.minute: r.status for r in I.incident_table(a, "2024-01-01 00:45:00").collect()}
    assert t == {0: "Expired", 40: "Active"}


def random_rows(n=400, seed=4):
    rnd = random.Random(seed)
    spots = [(f"s{i}", 50 + rnd.random() * 0.6, 37 + rnd.random() * 0.8) for i in range(15)]
    rows, minute = [], 0.0
    for i in range(n):
        minute += rnd.choice([0, 0.05, 2, 7, 15, 130])
        status = rnd.choice(["Active"] * 6 + ["Watch", "Terminated"])
        places = [] if status == "Terminated" and rnd.random() < 0.5 else rnd.sample(spots, rnd.choice([1, 1, 2]))
        clear = rnd.choice([None, "FPV", "Drone"]) if not places else None
        rows.append(msg(i, minute, rnd.choice(["FPV", "Recon", "StrikeDrone", "Rocket", "Unknown"]), places, status,
                        clear, rnd.choice([1, 1, 2])))
    return rows


def whole_stream(rows):
    """The reference result: one state per scope over the whole stream, no chunks."""
    states, out = {}, set()
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        state = states.setdefault(r[0], I.OpenIncidents(LIMITS))
        m = {"id": r[1], "t": r[2].replace(tzinfo=dt.timezone.utc).timestamp(), "type": r[3], "category": r[4],
             "status": r[5], "destroyed": r[6], "confidence": r[7], "clear_type": r[9],
             "places": [dict(zip(("name", "lat", "lon"), p)) for p in r[8]]}
        out |= {(r[1], o.get("root"), o["action"]) for o in state.process(m) or [{"action": "none"}]}
    return out


def test_chunked_replay_equals_whole_stream(spark):
    rows = random_rows()
    got = I.assign(spark.createDataFrame(rows, SCHEMA))
    have = {(r.message_id, r.root, r.action) for r in got.collect()}
    assert have == whole_stream(rows)
    assert {a for _, _, a in have} >= {"new", "same", "closed_by_type", "closed_by_place", "closed_latest", "none"}


def test_stream_equals_batch(spark, tmp_path):
    rows = sorted(random_rows(200, 5), key=lambda r: (r[2], r[1]))
    df = spark.createDataFrame(rows, SCHEMA)
    src = str(tmp_path / "in")
    for a in range(0, 200, 50):  # four micro-batches in time order
        spark.createDataFrame(rows[a:a + 50], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = J.message_stream(spark, src, df.schema, maxFilesPerTrigger=1)
    got = J.run_available(J.assign_stream(stream, delay="1 day"), "assign-test").where("action <> 'expired'")
    assert {(r.message_id, r.root, r.action) for r in got.collect()} == whole_stream(rows)


def test_linked_breaks_on_speed_and_silence(spark):
    rows = [msg(1, 0), msg(2, 10, places=[B]), msg(3, 11, places=[FAR]), msg(4, 12, places=[FAR]), msg(5, 90, places=[FAR])]
    got = {r.message_id: r.link_no for r in I.linked(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3}


def test_closed_by_place_at_the_borders(spark):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    inc = spark.createDataFrame([(1, t(10), t(12)), (2, t(10), t(12)), (3, t(10), t(10))], "incident_id long, first_seen timestamp, last_seen timestamp")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "incident_id long, place string")
    clr = spark.createDataFrame([("a", t(13)), ("b", t(13, 1)), ("b", t(8, 59)), ("c", t(9))], "place string, clear_ts timestamp")
    assert {r.incident_id for r in I.closed_by_place(inc, first, clr).collect()} == {1, 3}


def test_edges_use_closed_form_of_the_running_deviation(spark):
    rnd = random.Random(1)
    rows = [("a", "b", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i, rnd.random() * 5) for i in range(40)]
    df = spark.createDataFrame(rows, "src string, dst string, first_seen timestamp, incident_id long, hours double")
    mean = dev = 0.0
    for n, (*_, x) in enumerate(rows, 1):
        old = mean
        mean = (old * (n - 1) + x) / n
        dev = ((dev * dev * (n - 2) + (x - old) ** 2) / (n - 1)) ** 0.5 if n > 1 else 0.0
    assert P.delay_deviation(df).first().delay_dev == pytest.approx(dev)


def test_agreement_counts_pairs_of_predictors(spark):
    t = dt.datetime(2024, 1, 1)
    f = spark.createDataFrame([
        (1, "Graph", ["A", "b"], t), (1, "Statistical", ["a"], t), (2, "Graph", ["A"], t), (2, "Statistical", ["z"], t),
        (2, "Statistical", ["a"], t + dt.timedelta(1)), (3, "Graph", [], t), (3, "Statistical", [], t), (4, "Graph", ["A"], t)],
        "incident_id long, predictor string, places array<string>, created_at timestamp")
    r = RP.agreement(f).first()
    assert (r.compared, r.matched) == (3, 2)
