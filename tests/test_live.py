import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from test_incidents import SCHEMA, random_rows
from tocsin.operators import incidents as I
from tocsin.streaming import jobs as J, live as LV


def feed(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def keyed(df):
    return {(r.scope, r.message_id, r.root, r.action) for r in df.where("action <> 'expired'").collect()}


@pytest.fixture(scope="module")
def flow(spark, tmp_path_factory):
    """Four deliveries, each through a run of its own; some rows come twice and some far too late."""
    root, src = str(tmp_path_factory.mktemp("live") / "root"), str(tmp_path_factory.mktemp("feed") / "in")
    rows = sorted(random_rows(200, 9), key=lambda r: (r[2], r[1]))
    held, parts = [], []
    for a in range(0, 200, 50):
        part = rows[a:a + 50]
        if a == 50:
            held, part = part[::9], [r for i, r in enumerate(part) if i % 9]
        if a == 100:
            part = part + held + part[:3]
        parts.append(part)
    schema = spark.createDataFrame([], SCHEMA).schema
    for part in parts:
        feed(spark, src, part)
        LV.run_live(spark, src, schema, root, every_s=86_400, delay_s=600)
    return root, rows, held


def test_rows_are_main_or_late(spark, flow):
    root, rows, held = flow
    main = [r.message_id for r in LV.read(spark, root, "main").collect()]
    late = [r.message_id for r in LV.read(spark, root, "late").collect()]
    clock = max(r[2] for r in rows[:50] + [x for x in rows[50:100] if x not in held]) - dt.timedelta(minutes=10)
    assert sorted(late) == sorted(r[1] for r in held if r[2] < clock) and late
    assert sorted(main + late) == sorted(r[1] for r in rows)


def test_stream_over_main_equals_batch_and_rerun_takes_the_late(spark, flow):
    root, rows, _ = flow
    stream = LV.read(spark, root, "assigned")
    assert keyed(stream) == keyed(I.assign(LV.read(spark, root, "main")))
    assert keyed(LV.rerun(spark, root)) == keyed(I.assign(spark.createDataFrame(rows, SCHEMA)))


def test_alerts_use_only_what_was_known(spark, flow):
    root, *_ = flow
    assigned = LV.read(spark, root, "assigned")
    batch = assigned.where("action <> 'expired'")
    versions = {r[0] for r in batch.where(F.size("added") > 0).select(LV.period(F.col("ts"), 86_400)).distinct().collect()}
    assert versions == LV.known_versions(spark, root)
    want = set()
    for v in versions:
        past = batch.where(F.col("ts") < F.timestamp_seconds(F.lit(v)))
        stats = LV.statistics(past).withColumn("version", F.lit(v).cast("long"))
        own = batch.where(LV.period(F.col("ts"), 86_400) == v)
        want |= {(r.message_id, r.payload) for r in LV.to_alerts(LV.forecasts(own, stats, 86_400), 0.6).collect()}
    got = {(r.message_id, r.payload) for r in LV.read(spark, root, "alerts").collect()}
    assert got == want and any(len(r.next_places) for r in LV.read(spark, root, "alerts").collect())


def test_a_complete_batch_is_not_written_again(spark, flow):
    root, rows, _ = flow
    before = LV.read(spark, root, "main").count()
    schema = spark.createDataFrame([], SCHEMA).schema
    put = {}

    class Writer:
        def foreachBatch(self, fn):
            put["fn"] = fn
            return self

    class Stream:
        sparkSession, writeStream = spark, Writer()

    Stream.schema = schema
    LV.split_late(Stream, root, ["scope", "message_id"])
    put["fn"](spark.createDataFrame([(9, 10**6, *rows[0][2:])], SCHEMA), 0)
    assert LV.read(spark, root, "main").count() == before


def test_expired_rows(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    place = [("A", 50.0, 37.0)]
    row = lambda i, m, typ, scope=1: (scope, i, t(m), typ, "Drone", "Active", False, 0.5, place, None)
    src = str(tmp_path / "in")
    feed(spark, src, [row(1, 0, "FPV"), row(2, 1, "Recon", 2), row(3, 2, "Unknown", 3)])
    feed(spark, src, [row(4, 50, "FPV")])                # the first one ran out at minute 30
    feed(spark, src, [row(5, 140, "Rocket", 4)])         # the clock passes the second one at 121, not the third at 122 + 10
    schema = spark.createDataFrame([], SCHEMA).schema
    got = J.run_available(J.assign_stream(J.message_stream(spark, src, schema, maxFilesPerTrigger=1)), "expired")
    gone = {(r.scope, r.root): (r.ts, r.status, r.message_id) for r in got.where("action = 'expired'").collect()}
    assert gone == {(1, 1): (t(30), "Expired", None), (1, 4): (t(80), "Expired", None), (2, 2): (t(121), "Expired", None),
                    (3, 3): (t(122), "Expired", None)}


def brute_oldest(incidents, points, clears):
    life = {"FPV": 30, "Recon": 120, "Other": 120}
    closed, out = set(), set()
    for cid, (scope, at, names) in sorted(clears.items(), key=lambda x: (x[1][1], x[0])):
        for iid, (s, typ, first, last) in sorted(incidents.items(), key=lambda x: (x[1][2], x[0])):
            seen = {p.lower() for p, t in points[iid] if t <= at}
            if s == scope and iid not in closed and first <= at <= last + dt.timedelta(minutes=life[typ]) and seen & {n.lower() for n in names}:
                closed.add(iid)
                out.add((cid, iid))
                break
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_oldest_open_incident_at_a_place(spark, seed):
    r = random.Random(seed)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=r.randrange(600))
    points = {i: sorted(((r.choice("abcdeF"), at()) for _ in range(r.randint(1, 4))), key=lambda x: x[1]) for i in range(60)}
    incidents = {i: (r.choice([1, 1, 2]), r.choice(["FPV", "Recon", "Other"]), p[0][1], p[-1][1]) for i, p in points.items()}
    clears = {100 + k: (r.choice([1, 2]), at(), r.sample("ABCDEFG", r.choice([1, 2]))) for k in range(80)}
    inc = spark.createDataFrame([(v[0], k, *v[1:]) for k, v in incidents.items()],
                                "scope long, incident_id long, type string, first_seen timestamp, last_seen timestamp")
    pts = spark.createDataFrame([(k, *p) for k, v in points.items() for p in v], "incident_id long, place string, ts timestamp")
    clr = spark.createDataFrame([(s, t, c, n) for c, (s, t, names) in clears.items() for n in names],
                                "scope long, clear_ts timestamp, clear_id long, place string")
    got = {(x.clear_id, x.incident_id) for x in I.closed_oldest(inc, pts, clr).collect()}
    assert got == brute_oldest(incidents, points, clears) and len(got) > 10
    assert I.closed_oldest(inc, pts, clr.limit(0)).collect() == []


def test_a_slice_of_many_files_is_one_batch(spark, tmp_path, monkeypatch):
    from tocsin.catalog import queries as Q
    r, t = random.Random(3), dt.datetime(2024, 1, 1)
    events = [(i, t + dt.timedelta(minutes=i * 100 + r.randrange(90)), r.randrange(30), r.choice(["view", "click"])) for i in range(300)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, f"s{i}") for i in range(20)], "s_suppkey long, s_name string").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    taken = []
    run = Q.LV.run_live
    monkeypatch.setattr(Q.LV, "run_live", lambda *a, **k: (taken.append(k["maxFilesPerTrigger"]), run(*a, **k)))
    rows = []
    for size in (50_000, 10):
        monkeypatch.setattr(Q, "SLICE_FILE_ROWS", size)
        rows.append(sorted(tuple(x) for x in Q.live_late(spark, str(tmp_path)).collect()))
    assert taken[0] == 1 and taken[1] > 1
    assert rows[0] == rows[1] and len(rows[0]) == 300 and any(x[2] for x in rows[0])
