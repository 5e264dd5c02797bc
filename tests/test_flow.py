import datetime as dt

import pytest
from pyspark.sql import functions as F

from tocsin.operators import reports as RP
from tocsin.plans import flow
from tocsin.schemas import RAW_MESSAGE
from tocsin.sources import tables as TB

PLACES = [(0, "Бирюч", 50.25, 37.72), (1, "Валуйки", 50.21, 38.10), (2, "Борки", 50.15, 37.88), (3, "Вейделевка", 50.15, 38.44)]


@pytest.fixture(scope="module")
def outcome(spark):
    t0 = dt.datetime(2024, 1, 1, 9)
    texts = [  # (minutes, sender, text, reply)
        (0, "Небо", "ФПВ над Бирюч", None),
        (6, "Небо", "фпв от бирюч на борки", None),
        (8, "Спам", "фпв над Валуйки", None),
        (9, "Небо", "фпв, в укрытие!", "1"),
        (16, "Небо", "фпв замечен Валуйки", None),
        (20, "Небо", "разведчик в районе Вейделевка https://t.me/x 🚀", None),
        (30, "Небо", "отбой фпв", None),
        (31, "Небо", "  ", None),
    ]
    rows = [(str(i), "archive", s, x, t0 + dt.timedelta(minutes=m), t0 + dt.timedelta(minutes=m), 3, None, r)
            for i, (m, s, x, r) in enumerate(texts)]
    raw = spark.createDataFrame(rows, RAW_MESSAGE).withColumn("chat", F.lit("канал"))
    places = spark.createDataFrame(PLACES, "place_id long, name string, lat double, lon double")
    weights = spark.createDataFrame([("Небо", 0.9)], "name string, weight double")
    return flow.process(raw, places, weights, blocked=["спам"], as_of="2024-01-01 10:00:00"), places


def test_messages(outcome):
    m = {r.message_id: r for r in outcome[0].messages.collect()}
    assert set(m) == {"0", "1", "3", "4", "5", "6"}
    assert m["1"].direction == "Бирюч->Борки"
    assert [p.name for p in m["3"].places] == [p.name for p in m["1"].places] and "ContextFromReply" in m["3"].flags
    assert m["5"].type == "Recon" and m["5"].text == "разведчик в районе Вейделевка"
    # 0.4 base + 0.1 place + 0.2 type + 0.05 active, weighed by 0.5 + 0.5 * 0.9
    assert m["0"].confidence == pytest.approx(0.75 * 0.95)
    assert m["0"].incident_id == m["1"].incident_id == m["4"].incident_id != m["5"].incident_id


def test_incidents_and_points(outcome):
    # the reply repeats both places three minutes later: too fast for the first object, so a second one
    inc = sorted((r.type, r.status, r.n_points) for r in outcome[0].incidents.collect())
    assert inc == [("FPV", "Terminated", 2), ("FPV", "Terminated", 3), ("Recon", "Active", 1)]
    first = outcome[0].messages.where("message_id = '0'").first().incident_id
    pts = outcome[0].points.where(F.col("incident_id") == first).orderBy("ts").collect()
    assert [p.place for p in pts] == ["Бирюч", "Борки", "Валуйки"]


def test_forecast_report_and_payload(outcome, spark):
    out, places = outcome
    f = flow.forecast(out, places).collect()
    assert [(r.type, r.predictor, r.places, r.confidence) for r in f] == [("Recon", "Bayesian", ["Вейделевка"], 0.7)]
    tables = RP.report(out.incidents, out.points, None)
    assert {r.type: r.n for r in tables["types"].collect()} == {"FPV": 2, "Recon": 1}
    assert RP.report_text(tables).count() >= 6
    p = out.messages.select(TB.payload(F.col("ts"), F.col("sender"), F.col("type"), F.col("category"),
                                       F.transform("places", lambda x: x["name"]), F.col("direction"), F.col("status"),
                                       F.col("confidence"), F.col("text")))
    assert all(len(r[0]) <= 200 for r in p.collect())


@pytest.mark.parametrize("mode", ["tfidf", "ensemble"])
def test_other_contexts(outcome, mode):
    m = outcome[0].messages.select("chat", "ts", "mid", "type", "text").withColumns(
        {"n_places": F.lit(0), "tokens": F.split("text", " "), "tokens_tfidf": F.split("text", " ")})
    assert flow.context_of(m, mode).count() == 0
