import math
import random

import pytest
from pyspark.sql import functions as F

from tocsin.operators import sizing, spatial as S
from tocsin.operators.incidents import _km


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(11)
    places = [(i, f"p{i}", 49.5 + rnd.random() * 2, 36.5 + rnd.random() * 2.5) for i in range(150)]
    places += [(900 + i, f"copy{i}", places[0][2], places[0][3]) for i in range(10)]  # many at one spot
    pts = [(i, 49.4 + rnd.random() * 2.2, 36.4 + rnd.random() * 2.7) for i in range(200)]
    return (places, spark.createDataFrame(places, "place_id long, name string, lat double, lon double"),
            pts, spark.createDataFrame(pts, "id long, la double, lo double"))


def test_nearest_place_equals_brute_force(world):
    places, pdf, pts, df = world
    got = {r.id: (r.place_id, r.dist) for r in S.nearest_place(df, pdf, "la", "lo").collect()}
    for i, la, lo in pts:
        d, pid = min((_km(la, lo, p[2], p[3]), p[0]) for p in places)
        assert got[i][0] == pid and math.isclose(got[i][1], d, rel_tol=1e-9)


def test_within_radius_equals_brute_force(world):
    places, pdf, pts, df = world
    w = S.attach_places(S.within_radius(df, pdf, "la", "lo", 7.0), pdf)
    got = {(r.id, r.place_id) for r in w.collect()}
    assert got == {(i, p[0]) for i, la, lo in pts for p in places if _km(la, lo, p[2], p[3]) <= 7.0}


def test_nearest_k_with_copies(world):
    places, pdf, pts, df = world
    got = {}
    for r in S.nearest_k(S.origins_of(df, "la", "lo"), pdf, 5).collect():
        got.setdefault((r.lat0, r.lon0), []).append((r["rank"], r.place_id))
    for _, la, lo in pts:
        want = [p for _, p in sorted((_km(la, lo, p[2], p[3]), p[0]) for p in places)[:5]]
        assert [p for _, p in sorted(got[(la, lo)])] == want


def globe(seed, n):
    """Places over the whole globe, in clusters, around the poles and on both sides of the 180th meridian."""
    r = random.Random(seed)
    out = [(90.0, 0.0), (-90.0, 10.0), (0.0, 180.0), (0.0, -180.0), (89.99, -170.0)]
    while len(out) < n:
        kind = r.randrange(4)
        lat = [r.uniform(-90, 90), r.uniform(88, 90), r.uniform(-1, 1), 50 + r.gauss(0, 0.05)][kind]
        lon = [r.uniform(-180, 180), r.uniform(-180, 180), r.choice([-180, 179.5]) + r.random() * 0.5, 37 + r.gauss(0, 0.05)][kind]
        out.append((lat, lon))
    return out


def km(a, b):
    """Exact also for places that nearly face each other."""
    v = [(math.cos(math.radians(p)) * math.cos(math.radians(q)), math.cos(math.radians(p)) * math.sin(math.radians(q)), math.sin(math.radians(p)))
         for p, q in (a, b)]
    return 2 * 6371.0 * math.asin(min(1.0, math.dist(*v) / 2))


@pytest.mark.parametrize("n,k", [(400, 1), (400, 4), (3, 5)])
def test_nearest_over_the_whole_globe(spark, n, k):
    spots, origins = globe(1, n), globe(2, 120)
    pdf = spark.createDataFrame([(i, f"p{i}", *s) for i, s in enumerate(spots)], "place_id long, name string, lat double, lon double")
    odf = spark.createDataFrame([(i, *o) for i, o in enumerate(origins)], "id long, la double, lo double")
    got = {}
    for r in S.nearest_k(S.origins_of(odf, "la", "lo"), pdf, k).collect():
        got.setdefault((r.lat0, r.lon0), []).append((r["rank"], r.dist))
    near = {r.id: r.dist for r in S.nearest_place(odf, pdf, "la", "lo").collect()}
    for i, o in enumerate(origins):
        want = sorted(km(o, s) for s in spots)[:k]
        assert [d for _, d in sorted(got[o])] == pytest.approx(want, abs=1e-3)
        assert near[i] == pytest.approx(want[0], abs=1e-3)


@pytest.mark.parametrize("radius", [7.0, 300.0, 15_000.0])
def test_radius_over_the_whole_globe(spark, radius):
    spots, origins = globe(3, 150), globe(4, 80)
    pdf = spark.createDataFrame([(i, f"p{i}", *s) for i, s in enumerate(spots)], "place_id long, name string, lat double, lon double")
    odf = spark.createDataFrame([(i, *o) for i, o in enumerate(origins)], "id long, la double, lo double")
    got = {(r.id, r.place_id) for r in S.attach_places(S.within_radius(odf, pdf, "la", "lo", radius), pdf).collect()}
    want = {(i, j) for i, o in enumerate(origins) for j, s in enumerate(spots) if km(o, s) <= radius}
    assert got == want and want


def test_many_places_without_a_cross_join(spark):
    pdf = spark.range(100_000).selectExpr("id as place_id", "concat('p', id) as name", "degrees(asin(2 * rand(1) - 1)) as lat", "360 * rand(2) - 180 as lon")
    odf = spark.range(500).selectExpr("id", "degrees(asin(2 * rand(3) - 1)) as la", "360 * rand(4) - 180 as lo")
    for df in (S.nearest_k(S.origins_of(odf, "la", "lo"), pdf, 5), S.nearest_place(odf, pdf, "la", "lo"), S.within_radius(odf, pdf, "la", "lo", 50.0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    p = pdf.collect()
    some = {r.id: r.dist for r in S.nearest_place(odf, pdf, "la", "lo").collect()}
    for r in odf.limit(20).collect():
        assert some[r.id] == pytest.approx(min(km((r.la, r.lo), (x.lat, x.lon)) for x in p), abs=1e-3)


def test_no_places_and_null_coordinates(spark):
    pdf = spark.createDataFrame([(1, "a", 50.0, 37.0)], "place_id long, name string, lat double, lon double")
    odf = spark.createDataFrame([(1, None, 37.0), (2, 50.0, 37.0)], "id long, la double, lo double")
    assert {r.id: r.place_id for r in S.nearest_place(odf, pdf, "la", "lo").collect()} == {1: None, 2: 1}
    assert {r.id: r.place_id for r in S.nearest_place(odf, pdf.limit(0), "la", "lo").collect()} == {1: None, 2: None}
    assert S.nearest_k(S.origins_of(odf, "la", "lo"), pdf.limit(0), 2).collect() == []


def test_block_join_gives_the_same_pairs(world):
    _, pdf, _, df = world
    a = sizing.pair_with(df, pdf).count()
    b = sizing.pair_with(df, pdf, max_rows=10, blocks=7)
    assert a == b.count() == b.distinct().count()


def test_boxes(world):
    places, pdf, _, _ = world
    box = pdf.sparkSession.createDataFrame([(1, 50.0, 50.6, 37.0, 38.3)],
                                           "b int, min_lat double, max_lat double, min_lon double, max_lon double")
    got = {r.place_id for r in S.places_in_boxes(box, pdf).collect()}
    assert got == {p[0] for p in places if 50.0 <= p[2] <= 50.6 and 37.0 <= p[3] <= 38.3}


def test_administrative_names(spark):
    df = spark.createDataFrame([("Валуйский район",), ("Симоновка",), ("Красный МО",), ("Бирюч",)], "n string")
    flags = lambda s: [r[0] for r in df.select(S.is_administrative(F.col("n"), s)).collect()]
    assert flags("word") == [True, False, True, False]
    assert flags("any") == [True, True, True, False]
    assert flags(None) == [True, False, False, False]


def test_corridor_of_one_point_and_of_a_path(spark):
    rows = [(1, 50.0, 37.0, None), (2, 50.0, 37.0, None), (2, 50.09, 37.0, (50.0, 37.0))]
    df = spark.createDataFrame(rows, "incident_id long, lat double, lon double, prev struct<lat:double,lon:double>")
    got = S.corridor_samples(df, "incident_id").groupBy("incident_id").count().collect()
    assert {r.incident_id: r["count"] for r in got} == {1: 1, 2: 6}  # 10 km: five steps


@pytest.mark.parametrize("pick", ["near", "limit", "far"])
def test_within_radius_decides_at_the_limit_by_great_circle(spark, pick):
    rnd = random.Random(6)
    spots = [(i, rnd.choice([0.0, 50.0, 89.9, -60.0]) + i / 1000, rnd.choice([-180.0, 0.0, 37.0, 179.99])) for i in range(60)]
    pdf = spark.createDataFrame(spots, "place_id long, lat double, lon double")
    df = spark.createDataFrame([(i, a + 1e-4 * (i % 3), b) for i, a, b in spots], "id long, la double, lo double")
    pairs = df.crossJoin(pdf.select(F.col("lat").alias("plat"), F.col("lon").alias("plon")).distinct()).withColumn(
        "d", S.haversine_km(F.col("la"), F.col("lo"), F.col("plat"), F.col("plon"))).collect()
    far = sorted(r.d for r in pairs)
    km = {"near": 0.001, "limit": next(d for d in far if d > 1), "far": far[-1]}[pick]  # a pair is just as far apart
    got = {(r.id, r.plat, r.plon, r.dist) for r in S.within_radius(df, pdf, "la", "lo", km).collect()}
    assert got == {(r.id, r.plat, r.plon, r.d) for r in pairs if r.d <= km and abs(r.la - r.plat) <= km / S.KM_PER_DEGREE * 1.02}
    plan = S.within_radius(df, pdf, "la", "lo", km).drop("dist")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("CASE WHEN") < plan.index("ATAN2")  # the straight distance comes first


def test_box_totals_equal_brute_force_and_make_no_pairs(spark):
    rnd = random.Random(5)
    places = [(i, f"p{i}", round(-0.05 + rnd.random() * 0.2, 3), round(-0.05 + rnd.random() * 0.2, 3)) for i in range(300)]
    places += [(1000 + i, "same", 0.0, 0.0) for i in range(20)] + [(2000, "none", None, 0.0)]
    spans = [sorted(round(-0.06 + rnd.random() * 0.22, 3) for _ in range(2)) + sorted(round(-0.06 + rnd.random() * 0.22, 3) for _ in range(2)) for _ in range(40)]
    spans += [[0.0, 0.0, 0.0, 0.0], [5.0, 6.0, 5.0, 6.0]]
    boxes = [(None if i == 3 else i, *s) for i, s in enumerate(spans)] + [(99, None, None, 0.0, 0.1)]
    pdf = spark.createDataFrame(places, "place_id long, name string, lat double, lon double")
    df = S.places_in_boxes(spark.createDataFrame(boxes, "b int, min_lat double, max_lat double, min_lon double, max_lon double"), pdf, totals=1e-3)
    want = {}
    for b, a, z, w, e in boxes[:-1]:
        hit = [p[0] for p in places if p[2] is not None and a <= p[2] <= z and w <= p[3] <= e]
        if hit:
            want[b] = (len(hit), min(hit))
    assert {r.b: (r.n, r.first_place) for r in df.collect()} == want
    assert not [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "place_id" in x and "Join" in x]


@pytest.mark.parametrize("few", [True, False])
def test_box_totals_broadcast_no_rectangles_of_boxes(spark, monkeypatch, few):
    monkeypatch.setattr(S, "BROADCAST_KEYS", 300_000 if few else 0)
    monkeypatch.setattr(S, "BOXES_A_TASK", 7)
    places = [(i, (i * 37 % 101) / 1000, (i * 53 % 97) / 1000) for i in range(150)]
    boxes = [(i, i / 1000, (i + 40) / 1000, (90 - i) / 1000, (95 - i % 3) / 1000) for i in range(50)] * 2
    pdf = spark.createDataFrame(places, "place_id long, lat double, lon double")
    df = S.places_in_boxes(spark.createDataFrame(boxes, "b int, min_lat double, max_lat double, min_lon double, max_lon double"), pdf, totals=1e-3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and ("BuildRight" in plan) == few
    want = {}
    for b, a, z, w, e in boxes:
        inside = [i for i, la, lo in places if a <= la <= z and w <= lo <= e]
        if inside:
            n, first = want.get(b, (0, min(inside)))
            want[b] = (n + len(inside), first)
    assert {r.b: (r.n, r.first_place) for r in df.collect()} == want


def test_attached_places_follow_each_other_by_coordinate(spark):
    places = [(i, f"p{i}", 50.0 + i % 3 / 100, 37.0) for i in range(30)]
    pdf = spark.createDataFrame(places, "place_id long, name string, lat double, lon double")
    hits = spark.createDataFrame([(k, 50.0 + (k * 2) % 3 / 100, 37.0) for k in range(60)], "id long, plat double, plon double")
    df = S.attach_places(hits, pdf)
    rows = df.coalesce(1).collect()
    assert {(r.id, r.place_id) for r in rows} == {(k, p[0]) for k in range(60) for p in places if p[2] == 50.0 + (k * 2) % 3 / 100}
    runs = [r.plat for i, r in enumerate(rows) if i == 0 or rows[i - 1].plat != r.plat]
    assert len(runs) == 3 and len({r.id for r in rows[:10]}) == 1


def test_distinct_by_path_needs_no_shuffle_after_the_samples(spark):
    rows = [(k, 50.0, 37.0 + k / 100, (50.0, 37.0)) for k in range(20)]
    df = spark.createDataFrame(rows, "incident_id long, lat double, lon double, prev struct<lat:double,lon:double>")
    s = S.corridor_samples(df, "incident_id")
    plain = s._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(incident_id")
    once = s.distinct()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(incident_id")
    assert plain == once
