import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tocsin import settings as S
from tocsin.functions import geo as G, rules as R, text as T
from tocsin.functions.timeparts import period_bounds
from tocsin.operators.messages import classify


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def cut_slow(word):
    for e in S.ENDINGS:
        if len(word) >= len(e) + 2 and word.endswith(e):
            return word[: -len(e)]
    return word


def test_endings_equal_first_rule_wins(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("ившсьоваягемнйщуюыт") for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    assert column(spark, words, T.cut_ending) == [cut_slow(w) for w in words]


def test_normal_forms(spark):
    assert column(spark, ["Ёлкино", "Белый Колодезь"], T.normal_phrase) == ["елкин", "белый колодез"]
    assert column(spark, ["Над Валуйками: дрон!"], T.normal_text) == ["над валуйк дрон "]


def test_clean_and_dedup_forms(spark):
    raw = "Внимание 🚀  БПЛА на Бирюч 12:45 https://t.me/x ☀ "
    assert column(spark, [raw], T.clean_message) == ["Внимание БПЛА на Бирюч 12:45"]
    assert column(spark, [raw], T.dedup_form) == ["внимание бпла на бирюч <TIME>"]
    assert column(spark, ['Канал в MAX - бпла канал оповещения "Небо" тут'], T.dedup_form) == ["бпла тут"]


def test_tokens_keep_cyrillic_words(spark):
    got = column(spark, ["Дрон летит на Старый-Оскол, дрон"], lambda c: T.tokens(c, S.STOP_WORDS, 3))
    assert got == [["летит", "старый-оскол"]]


def test_levenshtein_similarity_and_bigrams(spark):
    df = spark.createDataFrame([("abcd", "abxd"), ("", ""), ("ab", "ba")], "a string, b string")
    rows = df.select(T.levenshtein_similarity(F.col("a"), F.col("b")), T.bigram_jaccard(F.col("a"), F.col("b"))).collect()
    assert rows[0][0] == pytest.approx(0.75) and rows[1][0] == 1.0
    assert rows[0][1] == pytest.approx(1 / 5) and rows[2][1] == 0.0


def test_grams_over_long_text(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcé ") for _ in range(n)) for n in (0, 2, 3, 199, 200, 201, 202, 203, 999)]
    got = column(spark, texts, lambda c: F.array_sort(T.grams(c, 3)))
    assert got == [sorted({t[i:i + 3] for i in range(len(t) - 2)}) for t in texts]


def test_cut_bytes_keeps_whole_characters(spark):
    got = column(spark, ["привет", "abc", "абв"], lambda c: T.cut_bytes(c, 5))
    assert got == ["пр...", "abc", "аб..."]


def test_expand_abbreviations(spark):
    assert column(spark, ["МО и г. мопс"], lambda c: T.expand_abbreviations(c, {"мо": "округ", "г": "город"})) == [
        "округ и город. мопс"]


@pytest.mark.parametrize("text, type_, category", [
    ("дрон на оптоволокне, ракета", "FpvFiberOptic", "Drone"),
    ("авиация и пуск ракет", "Rocket", "Missile"),          # ракет stands before авиация
    ("работает авиация, пуск", "Unknown", "Unknown"),       # авиация shadows пуск
    ("ударный бпла", "StrikeDrone", "Drone"),
    ("туман и ветер", "Unknown", "Weather"),
    ("фпв и ракета", "FPV", "Drone"),
    ("   ", "Unknown", "Unknown"),
])
def test_type_and_category(spark, text, type_, category):
    r = classify(spark.createDataFrame([(text,)], "text string")).first()
    assert (r.type, r.category) == (type_, category)


def test_status_flags_priority(spark):
    rows = classify(spark.createDataFrame(
        [("Отбой, дрон уничтожен, в укрытие",), ("дрон сбит, подтверждено",), ("Режим внимания!",), ("дартс",), ("",)],
        "text string")).collect()
    assert [r.status for r in rows] == ["Terminated", "Terminated", "Watch", "Active", "Active"]
    assert [r.flags for r in rows] == [["TakeCover"], ["Destroyed", "Confirmed"], [], [], ["EmptyText"]]
    assert [r.priority for r in rows] == [4, 5, 5, 1, 5]


def test_priority_variants_differ_only_in_strike_term(spark):
    assert column(spark, ["ударный"], lambda c: R.priority_class(c).cast("string")) == ["1"]
    assert column(spark, ["ударный", "ударный бпла"],
                  lambda c: R.priority_class(c, S.PRIORITY_TERMS_NOTIFICATION).cast("string")) == ["5", "1"]


def test_clear_type(spark):
    assert column(spark, ["отбой по ударному", "отбой ракетной", "отбой"], R.clear_type) == ["Drone", "Rocket", None]


def test_geodesy_round_trip(spark):
    df = spark.createDataFrame([(50.2, 38.1, 73.0, 25.0), (50.0, 37.0, 200.0, 3.0)], "la double, lo double, b double, km double")
    la, lo = G.destination(F.col("la"), F.col("lo"), F.col("b"), F.col("km"))
    d = df.withColumn("x", la).withColumn("y", lo)
    for r in d.select("b", "km", G.haversine_km(F.col("la"), F.col("lo"), F.col("x"), F.col("y")).alias("d"),
                      G.bearing_deg(F.col("la"), F.col("lo"), F.col("x"), F.col("y")).alias("a")).collect():
        assert math.isclose(r.d, r.km, rel_tol=1e-9) and math.isclose(r.a, r.b, rel_tol=1e-9)


def test_sectors_equal_inclusive_test(spark):
    az = [i * 0.25 for i in range(1440)]
    got = spark.createDataFrame([(a,) for a in az], "a double").select("a", G.sectors_of(F.col("a")).alias("s")).collect()
    for r in got:
        want = {s for s in range(0, 360, 5)
                if (s <= r.a <= s + 5) or (s == 355 and r.a == 0)}
        assert set(r.s) == want


def test_period_bounds():
    day = dt.date(2024, 3, 10)
    assert period_bounds("day", day) == (dt.datetime(2024, 3, 10), dt.datetime(2024, 3, 10, 23, 59, 59))
    assert period_bounds("week", day)[0] == dt.datetime(2024, 3, 3)
    assert period_bounds("month", day)[0] == dt.datetime(2024, 2, 9)
