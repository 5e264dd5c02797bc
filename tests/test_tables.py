import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tocsin.operators import messages as M, reports as RP
from tocsin.sources import archive as A, tables as TB
from tocsin.streaming import jobs as J

EXPORT = {"name": "Канал", "messages": [
    {"id": 1, "date": "2024-01-01T10:00:00", "date_unixtime": "1704103200", "from": "Кто", "text": "бпла"},
    {"id": 2, "date": "2024-01-01T11:00:00", "date_unixtime": 0, "text": ["над ", {"type": "bold", "text": "Бирюч"}, {"type": "x"}, 5]},
    {"id": 3, "date": "bad", "text": "без даты", "reply_to_message_id": 1},
    {"id": 4, "date": "2024-01-01T12:00:00", "text": "  "},
    {"id": 5, "date": "2024-01-02", "text": "поздно"},
]}


@pytest.fixture()
def export(tmp_path):
    p = tmp_path / "result.json"
    p.write_text(json.dumps(EXPORT, ensure_ascii=False), encoding="utf-8")
    return str(p)


def test_archive(spark, export):
    rows = {r.message_id: r for r in A.read_archive(spark, export).collect()}
    assert set(rows) == {"1", "2", "3", "5"}
    assert rows["1"].sender == "Кто" and rows["2"].sender == "Канал"
    assert rows["1"].received_at == dt.datetime(2024, 1, 1, 10)
    assert rows["2"].text == "над  Бирюч" and rows["2"].received_at == dt.datetime(2024, 1, 1, 11)
    assert rows["3"].rejected and rows["3"].reply_to == "1"
    assert rows["5"].received_at == dt.datetime(2024, 1, 2)


def test_landing_and_quality(spark, export, tmp_path):
    A.land_archive(spark, export, str(tmp_path / "land"))
    good = spark.read.parquet(str(tmp_path / "land" / "messages"))
    assert good.count() == 3 and spark.read.parquet(str(tmp_path / "land" / "rejects")).count() == 1
    q = A.quality(A.read_archive(spark, export)).first()
    assert (q.total, q.kept, q.no_date) == (4, 3, 1)
    assert [r.hour for r in A.busiest_hours(A.read_archive(spark, export)).collect()] == [0, 10, 11]


def test_places_and_profiles(spark, tmp_path):
    p = tmp_path / "places.json"
    p.write_text(json.dumps([{"Name": "Бирюч", "Lat": 50.2, "Lon": 37.7}, {"Name": "БИРЮЧ", "Lat": 1.0, "Lon": 1.0},
                             {"Name": "Яр", "Lat": 50.0, "Lon": 37.5}], ensure_ascii=False), encoding="utf-8")
    got = {r.name: r.lat for r in TB.read_places(spark, str(p)).collect()}
    assert got == {"Бирюч": 50.2, "Яр": 50.0}
    q = tmp_path / "profiles.json"
    q.write_text(json.dumps({"FPV": {"MaxSpeedKmh": 160, "MaxDistanceKm": 40, "LifetimeMinutes": 30}}, indent=1))
    assert TB.read_profiles(spark, str(q)).first().asDict() == {
        "type": "FPV", "max_speed_kmh": 160.0, "max_distance_km": 40.0, "lifetime_min": 30.0}


def test_messages_are_replaced_by_id(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    path = str(tmp_path / "m")
    schema = "message_id string, text string, received_at timestamp"
    TB.append_messages(spark.createDataFrame([("a", "old", t), ("b", "b", t)], schema), path)
    TB.append_messages(spark.createDataFrame([("a", "new", t + dt.timedelta(1))], schema), path)
    assert {r.message_id: r.text for r in TB.current_messages(spark, path).collect()} == {"a": "new", "b": "b"}


def test_incident_reads_push_filters(spark, tmp_path):
    path = str(tmp_path / "i")
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, t, "Active"), (2, t + dt.timedelta(9), "Watch"), (3, t, "Expired")],
                          "incident_id long, first_seen timestamp, status string").write.parquet(path)
    df = TB.read_incidents(spark, path, None, t + dt.timedelta(1), ["Active", "Watch"])
    assert [r.incident_id for r in df.collect()] == [1]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(first_seen)" in plan and "In(status" in plan


def test_payload_is_cut(spark):
    df = spark.createDataFrame([("короткий",), ("д" * 300,)], "t string")
    p = TB.payload(F.lit("2024-01-01 10:20:30").cast("timestamp"), F.lit("s"), F.lit("FPV"), F.lit("Drone"),
                   F.array(F.lit("A"), F.lit("B")), F.lit(None).cast("string"), F.lit("Active"), F.lit(0.5), F.col("t"))
    short, long = [r[0] for r in df.select(p).collect()]
    assert json.loads(short)["settlements"] == "A,B" and json.loads(short)["timestamp"] == "10:20:30"
    assert len(long) == 200 and long.endswith("...")


def test_forecasts_append_by_predictor_and_report_sink(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    f = spark.createDataFrame([(1, "Graph", 0.5, t), (1, "Trajectory", 0.7, t)],
                              "incident_id long, predictor string, confidence double, created_at timestamp")
    TB.append_forecasts(f, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert M.alerts(back, 0.6).first().predictor == "Trajectory"
    tables = {"predictors": RP.by_predictor(back)}
    TB.write_report(tables, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r" / "predictors")).count() == 2
    assert RP.report_text(tables).count() == 2


def feed(spark, tmp_path, rows, schema):
    path = str(tmp_path / "feed")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return J.message_stream(spark, path, spark.read.parquet(path).schema)


def test_stream_drops_known_ids_and_texts(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("s", "1", "a b", t), ("s", "1", "a  b", t), ("s", "2", "A b", t), ("s", "3", "c", t)]
    s = feed(spark, tmp_path, rows, "source_type string, message_id string, text string, received_at timestamp")
    assert J.run_available(J.first_seen_ids(s), "ids").count() == 3
    assert J.run_available(J.first_seen_texts(s, "source_type", "text", "received_at"), "texts").count() == 2


def test_stream_hours_and_context(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    m = dt.timedelta(minutes=1)
    rows = [(1, 1, 1, t), (1, 2, 0, t + 2 * m), (1, 3, 0, t + 9 * m), (1, 4, 1, t + 200 * m)]
    s = feed(spark, tmp_path, rows, "chat long, message_id long, n_places int, ts timestamp")
    hours = J.run_available(J.hourly_counts(s), "hours")
    assert [(r.hour.hour, r.n) for r in hours.collect()] == [(0, 3)]
    ctx = J.run_available(J.context_stream(s, "chat", "ts", "message_id"), "ctx")
    assert [(r.message_id, r.context_id) for r in ctx.collect()] == [(2, 1)]


def test_stream_retained_and_idempotent_sink(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    body = "внимание бпла летит на город с юга"
    rows = [(1, 1, body, t), (1, 2, body + "!", t + dt.timedelta(seconds=30)), (1, 3, body, t + dt.timedelta(seconds=300))]
    s = feed(spark, tmp_path, rows, "scope long, id long, text string, at timestamp")
    got = J.run_available(J.retained_stream(s, "scope", "text", "at", "id"), "retained")
    assert {r.message_id: r.duplicate_of for r in got.collect()} == {1: None, 2: 1, 3: None}
    out = str(tmp_path / "out")
    q = J.write_idempotent(s, out, str(tmp_path / "ck"), ["id"]).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 3
