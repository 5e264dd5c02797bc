import datetime as dt
import random

import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from tocsin.operators import context as C, dedup as D, gazetteer as G, messages as M
from tocsin.operators.replay import replay

PLACES = [(0, "Бирюч", 50.25, 37.72), (1, "Валуйки", 50.21, 38.1), (2, "Валуйский район", 50.2, 38.0),
          (3, "Борки", 50.14, 37.88), (4, "Новые Борки", 50.1, 37.8), (5, "Яр", 50.0, 37.5)]


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame(PLACES, "place_id long, name string, lat double, lon double")


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "message_id long, text string")


@pytest.mark.parametrize("scan_rows", [200, 0])
def test_extract_places(spark, places, scan_rows):
    m = texts(spark, "БПЛА над Валуйками, Валуйский район", "Валуйский район, внимание", "в сторону Борков", "тихо")
    got = {r.message_id: [p.name for p in r.places]
           for r in G.extract_places(m, places, scan_rows=scan_rows).collect()}
    assert got[0] == ["Валуйки"]
    assert got[2] == ["Борки"]
    assert 3 not in got


@pytest.mark.parametrize("scan_rows", [200, 0])
def test_best_place_prefers_exact_then_longest(spark, places, scan_rows):
    ph = spark.createDataFrame([("борки",), ("новые борки",), ("село валуйки",), ("нет",)], "phrase string")
    got = {r.phrase: r.place.name for r in G.best_place(ph, places, scan_rows=scan_rows).collect()}
    assert got == {"борки": "Борки", "новые борки": "Новые Борки", "село валуйки": "Валуйки"}


def test_directions(spark, places):
    m = texts(spark, "дрон от бирюч на валуйки", "летит на борки, бирюч", "Бирюч - Валуйки", "стоит в бирюч")
    found = G.extract_places(m, places)
    got = {r.message_id: r.direction for r in G.directions(m, places, found).collect()}
    assert got[0] == "Бирюч->Валуйки"
    # the normal form has no commas, and the list is split at every letter "и"
    assert got[1] == "->Борки"
    assert got[2] == "Бирюч->Валуйки"
    assert 3 not in got


def test_word_places(spark, places):
    got = G.word_places(texts(spark, "бирюч,валуйки;яр"), places, "message_id", "text").collect()
    assert {r.name for r in got} == {"Бирюч", "Валуйки"}


def test_sender_filters(spark):
    df = spark.createDataFrame([(s,) for s in ["Чистое небо 31", "Горыныч", "Ручной ввод", "ЧИСТОЕ НЕБО Семья"]], "sender string")
    got = {r.sender for r in M.filter_senders(df, ["чистое небо", "Ручной"], ["семья"]).collect()}
    assert got == {"Чистое небо 31", "Ручной ввод"}
    assert M.filter_senders(df).count() == 4
    terms = spark.createDataFrame([("горыныч",)], "t string")
    assert M.filter_senders(df, None, terms).count() == 3
    nulls = df.unionByName(df.limit(1).withColumn("sender", F.lit(None).cast("string")))
    assert M.filter_senders(nulls).count() == 5 and M.filter_senders(nulls, None, ["семья"]).where("sender is null").count() == 1
    assert M.filter_senders(nulls, None, terms).where("sender is null").count() == 1
    assert M.filter_senders(nulls, ["чистое небо"]).where("sender is null").count() == 0


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, prev = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance_and_its_filter():
    rnd = random.Random(2)
    for _ in range(300):
        a = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(0, 40)))
        b = list(a)
        for _ in range(rnd.randrange(0, 8)):
            b[rnd.randrange(len(b) + 1):][:0] = []
            if b and rnd.random() < 0.5:
                b.pop(rnd.randrange(len(b)))
            else:
                b.insert(rnd.randrange(len(b) + 1), rnd.choice("abcd"))
        b = "".join(b)
        d = slow_distance(a, b)
        assert D.edit_distance(a, b) == d
        w = max(len(a), len(b))
        if w and 1 - d / w >= 0.9:
            assert D.may_be_near((a, D.gram_counts(a)), (b, D.gram_counts(b)), 0.9)


def noisy_stream(spark, n=250, seed=8):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("абвгде ") for _ in range(60)) for _ in range(12)]
    rows, t = [], dt.datetime(2024, 1, 1)
    for i in range(n):
        t += dt.timedelta(seconds=rnd.choice([1, 5, 20, 60, 300]))
        s = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 9)):
            s[rnd.randrange(len(s))] = rnd.choice("абвгде")
        rows.append((rnd.choice([0, 0, 1]), i, t, "".join(s)))
    return rows, spark.createDataFrame(rows, "scope long, message_id long, ts timestamp, text string")


def norm(s):
    return " ".join(s.split())


def test_retained_equals_whole_stream_greedy(spark):
    rows, df = noisy_stream(spark)
    got = {r.message_id: r.duplicate_of for r in D.retained(df, "message_id", "text", "scope", "ts").collect()}
    want, bufs = {}, {}
    for sc, i, t, s in rows:
        buf = [b for b in bufs.get(sc, []) if (t - b[0]).total_seconds() <= 120]
        s = norm(s)
        best, who = 0.0, None
        for bt, bi, bs in buf:
            sim = 1.0 if bs == s else 1 - slow_distance(s, bs) / max(len(s), len(bs))
            if sim > best:
                best, who = sim, bi
        want[i] = who if best >= 0.9 else None
        if want[i] is None:
            buf = (buf + [(t, i, s)])[-50:]
        bufs[sc] = buf
    assert got == want and any(v is not None for v in want.values())


def test_near_pairs_equal_brute_force(spark):
    rows, df = noisy_stream(spark, seed=9)
    got = {(r.message_id, r.earlier_id) for r in D.near_pairs(df, "message_id", "text", ["scope"], "ts").collect()}
    want = set()
    for a, (sc, i, t, s) in enumerate(rows):
        before = [r for r in rows[:a] if r[0] == sc]
        for _, j, u, o in before:
            x, y = norm(s), norm(o)
            if (t - u).total_seconds() <= 120 and 1 - slow_distance(x, y) / max(len(x), len(y)) >= 0.9:
                want.add((i, j))
    assert got == want and want


def test_near_pairs_see_all_of_the_window(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(0, i, at + dt.timedelta(seconds=i / 2), f"text number {i % 70} with words that differ {i % 70:03d}" * 2) for i in range(140)]
    df = spark.createDataFrame(rows, "scope long, message_id long, ts timestamp, text string")
    got = D.near_pairs(df, "message_id", "text", ["scope"], "ts")
    equal = {(r.message_id, r.earlier_id) for r in got.where("similarity = 1").collect()}
    assert equal == {(i, i - 70) for i in range(70, 140)}


def test_replay_takes_null_scopes_and_times(spark):
    rows, _ = noisy_stream(spark)
    rows = [(None if sc == 0 else sc, i, t, s) for sc, i, t, s in rows] + [(None, 9001, None, "x"), (5, 9002, None, None), (5, 9003, rows[0][2], None)]
    schema = "scope long, message_id long, ts timestamp, text string"
    have = {r.message_id: r.duplicate_of for r in D.retained(spark.createDataFrame(rows, schema), "message_id", "text", "scope", "ts").collect()}
    plain = [(0 if sc is None else sc, i, t, s) for sc, i, t, s in rows[:-3]]
    want = {r.message_id: r.duplicate_of for r in D.retained(spark.createDataFrame(plain, schema), "message_id", "text", "scope", "ts").collect()}
    assert have == {**want, 9001: None, 9002: None, 9003: None}


def test_replay_that_repairs_nothing_stops(spark):
    class Stubborn:  # a state that in tasks never looks like the empty one of the driver
        def step(self, row):
            return [{}]

        def expire(self, now):
            pass

        def dump(self):
            return "never" if TaskContext.get() else "empty"

    df = spark.createDataFrame([(1, i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=10 * i)) for i in range(6)], "scope long, id long, ts timestamp")
    frame = lambda out: pd.DataFrame({"id": pd.array([r.id for r, _ in out], dtype="Int64")})
    with pytest.raises(RuntimeError, match="repaired nothing"):
        replay(df, "scope", "ts", "id", 10, 0, "id long", lambda dump: Stubborn(), frame, "stubborn")


def message(i, chat, t, n, typ="FPV", reply=None, toks=()):
    place = [("p%d" % k, 50.0, 37.0) for k in range(n)]
    return (chat, i, reply, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), typ, "Drone", "Active", None,
            [] if n else ["NoSettlements"], 0.75 if n else 0.3, n, place, list(toks))


SCHEMA = ("chat long, message_id long, reply_to long, ts timestamp, type string, category string, status string, "
          "direction string, flags array<string>, confidence double, n_places int, "
          "places array<struct<name:string,lat:double,lon:double>>, tokens array<string>")


def test_reply_context(spark):
    df = spark.createDataFrame([message(1, 7, 0, 2), message(2, 7, 9, 0, "Unknown", 1), message(3, 8, 9, 0, "X", 1)], SCHEMA)
    r = {x.message_id: x for x in C.reply_context(df).collect()}
    assert len(r[2].places) == 2 and r[2].type == "FPV" and r[2].confidence == pytest.approx(0.6)
    assert "ContextFromReply" in r[2].flags and r[3].places == []


def test_token_context_picks_best_recent(spark):
    df = spark.createDataFrame([
        message(1, 7, 0, 1, "FPV", None, ["a", "b", "c"]), message(2, 7, 60, 1, "Rocket", None, ["x", "y"]),
        message(3, 7, 100, 0, "FPV", None, ["a", "b"]), message(4, 7, 500, 0, "FPV", None, ["a", "b"])], SCHEMA)
    got = {r.message_id: (r.context_id, r.score) for r in C.token_context(df, ["chat"]).collect()}
    assert got[3][0] == 1
    assert got[3][1] == pytest.approx(2 / 3 + 0.2 + 0.1 * (1 - 100 / 300))
    assert 4 not in got  # five minutes have passed
    one = {r.message_id: r.context_id for r in C.tfidf_context(df, ["chat"]).collect()}
    assert one == {3: 1}
    both = C.combined_context(C.token_context(df, ["chat"]), C.tfidf_context(df, ["chat"]), df)
    assert [(r.message_id, r.context_id) for r in both.collect()] == [(3, 1)]
    applied = {r.message_id: r for r in C.apply_context(df, both).collect()}
    assert applied[3].confidence == pytest.approx(0.7 * 0.75) and "ContextApplied" in applied[3].flags


def test_terms_within_words_and_across_words(spark):
    texts = [(1, "the northgatehouse and northgatehouses by old mill"), (2, "oldmill"), (3, "millhouse  old mill"), (None, "northgate"), (5, None), (6, "")]
    terms = [(1, "northgate"), (2, "old mill"), (3, "house"), (4, "gat"), (5, " old"), (6, "ll"), (7, "absent")]
    t = spark.createDataFrame(texts, "k int, t string")
    n = spark.createDataFrame(terms, "id int, n string")
    want = sorted(((k, i) for k, x in texts if x is not None for i, y in terms if len(y) >= 3 and y in x), key=str)
    df = G.find_terms(t, n, "k", "t", "id", "n", scan_rows=0)
    assert sorted(((r.k, r.id) for r in df.collect()), key=str) == want
    # the texts meet words; no pieces are made of them
    only = G.find_terms(t, n.where("id = 1"), "k", "t", "id", "n", scan_rows=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "_g#" not in only and "_word#" in only
