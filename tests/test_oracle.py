"""Every registered query with SQL, side by side on the smallest tables; and the shape of some plans."""

import datetime as dt

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from tocsin import fixtures as X
from tocsin.operators import paths as P
from tocsin.operators.ordered import previous_row
from tocsin.plans import forecasts as FC

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    assert entry.entry(spark).columns == ["type", "from_place", "to_place", "n", "prob"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_matches_sql(spark, con, name):
    ok, note = compare(spark, con, SF, name)
    assert ok, note


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_scan_reads_only_needed_columns(spark):
    p = plan(P.transitions(X.points(spark, SF)))
    assert "value" not in p.split("events")[0] or "props" not in p
    assert "CartesianProduct" not in p


def test_global_order_windows_only_bucket_summaries(spark):
    events = X.table(spark, SF, "events").select("event_id", "ts")
    lines = plan(previous_row(events, [], "ts", ["event_id"], ["event_id"])).splitlines()
    single = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    assert len(single) == 1 and any("Aggregate(key" in line and "[_b#" in line for line in lines[single[0] + 1:single[0] + 3])
    assert not any("CartesianProduct" in line for line in lines)


def test_leg_speeds_are_made_once_a_row(spark):
    p = plan(P.speed_stats(X.points(spark, SF)).where("speed >= 0.1"))
    assert p.count("zip_with") == 1


def test_predictors_share_stored_incidents(spark, monkeypatch):
    t = dt.datetime(2024, 1, 1)
    rows = [(i % 7, "FPV", t + dt.timedelta(minutes=i), i, f"p{i % 5}", 50.0 + i / 100, 37.0, "Active") for i in range(40)]
    pts = spark.createDataFrame(rows, "incident_id long, type string, ts timestamp, event_id long, place string, lat double, lon double, mark string")
    x = FC.Inputs(incidents=P.rollup(pts), points=pts, places=X.places(spark, SF))
    seen = []
    monkeypatch.setattr(FC, "PREDICTORS", {k: lambda y: seen.append(y) or y.incidents for k in "ab"})
    FC.forecast(x)
    a, b = seen
    assert a.incidents is b.incidents is a.past_incidents and a.points is a.past_points
    assert a.incidents.inputFiles() and sorted(a.incidents.collect()) == sorted(x.incidents.collect())
    other = FC.Inputs(incidents=x.incidents, points=pts, places=x.places, past_incidents=P.rollup(pts))
    FC.forecast(other, ["a"])
    assert seen[-1].past_incidents is other.past_incidents
