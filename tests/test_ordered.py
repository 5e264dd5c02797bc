import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from tocsin.operators.dedup import islands
from tocsin.operators.replay import replay
from tocsin.operators.ordered import first_after, previous_row, running_totals, sessions, with_history


def stream(spark, n=600, seed=1, step=40):
    """Random rows; key 0 is hot (two thirds of the rows) and times tie often."""
    rnd = random.Random(seed)
    t0 = pd.Timestamp("2024-01-01 23:50:00")
    rows = [(rnd.choice([0, 0, 0, 1, 2]), t0 + pd.Timedelta(seconds=rnd.randrange(n * step // 10)), i, rnd.random())
            for i in range(n)]
    pdf = pd.DataFrame(rows, columns=["k", "ts", "id", "v"])
    return pdf, spark.createDataFrame(pdf)


def test_previous_row_equals_lag(spark):
    pdf, df = stream(spark)
    got = previous_row(df, ["k"], "ts", ["id"], ["id"], "p", 60).select("id", F.col("p.id").alias("p")).toPandas()
    want = pdf.sort_values(["ts", "id"]).assign(p=lambda x: x.groupby("k")["id"].shift())[["id", "p"]]
    pd.testing.assert_frame_equal(got.sort_values("id").reset_index(drop=True),
                                  want.sort_values("id").reset_index(drop=True), check_dtype=False)


def test_previous_row_without_key_crosses_days(spark):
    pdf, df = stream(spark, seed=2, step=3000)
    got = dict(previous_row(df, [], "ts", ["id"], ["id"], "p").select("id", "p.id").toPandas().dropna().values)
    ids = pdf.sort_values(["ts", "id"])["id"].tolist()
    assert got == {b: a for a, b in zip(ids, ids[1:])}


def test_running_totals_equal_cumsum(spark):
    pdf, df = stream(spark, seed=3)
    one = df.withColumn("one", F.lit(1))
    got = running_totals(one, ["k"], "ts", ["id"], {"s": "v", "n": "one"}).select("id", "s", "n").toPandas()
    w = pdf.sort_values(["ts", "id"])
    w = w.assign(s=w.groupby("k")["v"].cumsum(), n=w.groupby("k").cumcount() + 1)[["id", "s", "n"]]
    pd.testing.assert_frame_equal(got.sort_values("id").reset_index(drop=True),
                                  w.sort_values("id").reset_index(drop=True), check_dtype=False)


def test_history_equals_brute_force(spark):
    pdf, df = stream(spark, n=300, seed=4)
    got = with_history(df, ["k"], "ts", ["id"], ["id"], 5, 30, "h").select("id", F.col("h.id").alias("h")).collect()
    rows = pdf.sort_values(["ts", "id"]).to_dict("records")
    for r in got:
        me = next(x for x in rows if x["id"] == r.id)
        before = [x for x in rows if x["k"] == me["k"] and (x["ts"], x["id"]) < (me["ts"], me["id"])][-5:]
        assert r.h == [x["id"] for x in before if (me["ts"] - x["ts"]).total_seconds() <= 30]


def test_first_after_equals_brute_force(spark):
    left, ldf = stream(spark, n=200, seed=5)
    right, rdf = stream(spark, n=80, seed=6)
    got = first_after(ldf, rdf.select("k", F.col("ts").alias("rt")), ["k"], "ts", "rt", 100, "f").collect()
    assert len(got) == len(left)
    for r in got:
        c = [t for k, t in zip(right["k"], right["ts"]) if k == r.k and 0 < (t - r.ts).total_seconds() <= 100]
        assert r.f == (min(c).to_pydatetime() if c else None)


def test_islands_split_where_the_key_pauses(spark):
    pdf, df = stream(spark, n=150, seed=7, step=400)
    got = islands(df, ["k"], "ts", ["id"], 120).select("k", "ts", "id", "island").toPandas().sort_values(["k", "ts", "id"])
    for _, g in got.groupby("k"):
        gap = (g["ts"].diff().dt.total_seconds() > 120).cumsum() + 1
        assert gap.tolist() == g["island"].tolist()


def test_replay_repairs_every_wrong_start(spark):
    class Total:
        """A state that never forgets: every chunk depends on all chunks before it."""

        def __init__(self, dump=None):
            self.n = int(dump) if dump else 0

        def expire(self, now):
            pass

        def dump(self):
            return str(self.n)

        def step(self, row):
            self.n += int(row.id)
            return [{"total": self.n}]

    pdf, df = stream(spark, n=120, seed=9, step=20)  # 240 s in chunks of 40 s, no warm-up
    frame = lambda out: pd.DataFrame({"id": pd.array([r.id for r, _ in out], dtype="Int64"),
                                      "total": pd.array([o["total"] for _, o in out], dtype="Int64")})
    got = replay(df, "k", "ts", "id", 40, 0, "id long, total long", Total, frame, "total").toPandas()
    w = pdf.sort_values(["ts", "id"])
    want = dict(zip(w["id"], w.groupby("k")["id"].cumsum()))
    assert dict(zip(got["id"], got["total"])) == want


def test_hot_key_over_many_buckets(spark):
    """Buckets of a minute with long empty stretches between them; the same as one window a key."""
    pdf, df = stream(spark, n=400, seed=7, step=4000)
    w = pdf.sort_values(["ts", "id"])
    got = dict(previous_row(df, ["k"], "ts", ["id"], ["id"], "p", 60).select("id", "p.id").toPandas().dropna().values)
    want = w.assign(p=w.groupby("k")["id"].shift()).dropna(subset=["p"])
    assert got == dict(want[["id", "p"]].values)
    got = running_totals(df, ["k"], "ts", ["id"], {"s": "id"}, 60).select("id", "s").toPandas()
    assert dict(got.values) == dict(w.assign(s=w.groupby("k")["id"].cumsum())[["id", "s"]].values)


def test_null_keys_times_and_values(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(None, t, 1, None), (None, t + timedelta(days=3), 2, 5), (1, None, 3, 7), (1, t, 4, None)],
                               "k int, ts timestamp, id int, v int")
    assert dict(previous_row(df, ["k"], "ts", ["id"], ["id"], "p").select("id", "p.id").collect()) == {1: None, 2: 1, 3: None, 4: 3}
    assert dict(running_totals(df, ["k"], "ts", ["id"], {"s": "v"}).select("id", "s").collect()) == {1: None, 2: 5, 3: 7, 4: 7}
    assert previous_row(df.limit(0), ["k"], "ts", ["id"], ["id"]).count() == 0
    assert sessions(df, ["k"], "ts", F.lit(1)).where("k = 1").count() == 1


def test_sessions_equal_brute_force(spark):
    for seed, step, width in ((8, 40, 60), (9, 400, 60), (10, 4000, 600)):
        pdf, df = stream(spark, n=500, seed=seed, step=step)
        gap = F.when(F.col("k") == 0, 20).otherwise(150).cast("long") * 1_000_000
        got = {(r.k, r.start, r.last, r.n) for r in sessions(df, ["k"], "ts", gap, width).collect()}
        want = set()
        for k, part in pdf.sort_values("ts").groupby("k"):
            runs = []
            for t in part["ts"]:
                if runs and (t - runs[-1][-1]).total_seconds() < (20 if k == 0 else 150):
                    runs[-1].append(t)
                else:
                    runs.append([t])
            want |= {(k, r[0].to_pydatetime(), r[-1].to_pydatetime(), len(r)) for r in runs}
        assert got == want


def test_rows_are_shuffled_once_and_joined_to_nothing(spark):
    _, df = stream(spark)
    for plan in (previous_row(df, ["k"], "ts", ["id"], ["v"]), running_totals(df, ["k"], "ts", ["id"], {"s": "v"})):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in text and text.count("Exchange hashpartitioning") == 3
