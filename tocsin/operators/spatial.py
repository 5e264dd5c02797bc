"""Spatial jobs over a place dimension (place_id, name, lat, lon).

Places are first reduced to distinct coordinates. Exact pruning by grid cells keeps the number of
distance evaluations per fact row small, whatever the size of the dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tocsin.functions.geo import KM_PER_DEGREE, bearing_deg, cell, chord, haversine_km, sectors_of, unit_vector
from tocsin.operators.sizing import checked_broadcast, fits_broadcast, pair_with
from tocsin.session import cut_lineage
from tocsin.settings import ADMIN_SHORT, ADMIN_TERMS

CELL_DEG = 0.25
#: Rows of a broadcast of whole numbers only, about 100 bytes each in the join.
BROADCAST_KEYS = 300_000
#: Boxes of a task that makes their rectangles, a few hundred each at most.
BOXES_A_TASK = 100_000


def is_administrative(name: Column, short_form: str | None = "word") -> Column:
    """District / region names. ``short_form``: None, "word" (whole word) or "any" (inside words)."""
    low = F.lower(name)
    hit = F.lit(False)
    for term in ADMIN_TERMS:
        hit = hit | low.contains(term)
    if short_form == "word":
        hit = hit | name.rlike(rf"(?iu)(^|[^\p{{L}}\p{{N}}]){ADMIN_SHORT}($|[^\p{{L}}\p{{N}}])")
    elif short_form == "any":
        hit = hit | low.contains(ADMIN_SHORT.lower())
    return hit


def with_admin_flag(places: DataFrame, short_form: str | None = "word") -> DataFrame:
    return places.withColumn("is_admin", is_administrative(F.col("name"), short_form))


def coordinates(places: DataFrame, keep: int) -> DataFrame:
    """One row per distinct coordinate: count of non-administrative places, first ``keep`` places.

    No nearest-``keep`` answer can need more than ``keep`` places of one coordinate.
    """
    p = places if "is_admin" in places.columns else with_admin_flag(places)
    item = F.struct("place_id", "name", "is_admin")
    if keep == 1:
        return p.groupBy("lat", "lon").agg(F.count_if(~F.col("is_admin")).alias("n_plain"),
                                           F.array(F.min(item)).alias("firsts"))
    counts = p.groupBy("lat", "lon").agg(F.count_if(~F.col("is_admin")).alias("n_plain"))
    w = Window.partitionBy("lat", "lon").orderBy("place_id")
    firsts = (
        p.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep)
        .groupBy("lat", "lon")
        .agg(F.array_sort(F.collect_list(item)).alias("firsts"))
    )
    return counts.join(firsts, ["lat", "lon"])


def origins_of(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.select(F.col(lat).alias("lat0"), F.col(lon).alias("lon0")).distinct()


def _measured(origins: DataFrame, coords: DataFrame) -> DataFrame:
    """Distinct origins against distinct coordinates with distance and azimuth."""
    return (
        pair_with(origins, coords)
        .withColumn("dist", haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")))
        .withColumn("azimuth", bearing_deg(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")))
    )


def pair_distance(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """Distance and azimuth of named place pairs (from_name, to_name): the matrix, by lookup only."""
    p = places.select("name", "lat", "lon").dropDuplicates(["name"])
    a = p.select(F.col("name").alias("from_name"), F.col("lat").alias("_la"), F.col("lon").alias("_lo"))
    b = p.select(F.col("name").alias("to_name"), F.col("lat").alias("_lb"), F.col("lon").alias("_lp"))
    j = pairs.join(a, "from_name").join(b, "to_name")
    same = F.col("from_name") == F.col("to_name")
    return (
        j.withColumn("dist_km", F.when(same, 0.0).otherwise(
            haversine_km(F.col("_la"), F.col("_lo"), F.col("_lb"), F.col("_lp"))))
        .withColumn("azimuth", F.when(same, 0.0).otherwise(
            bearing_deg(F.col("_la"), F.col("_lo"), F.col("_lb"), F.col("_lp"))))
        .drop("_la", "_lo", "_lb", "_lp")
    )


def _top_places(measured: DataFrame, by: list[str], k: int) -> DataFrame:
    """First ``k`` places by (distance, place_id) within ``by`` from rows of whole coordinates."""
    near = Window.partitionBy(*by).orderBy("dist", F.col("firsts")[0]["place_id"])
    few = measured.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k).drop("_r")
    one = few.withColumn("p", F.explode("firsts")).drop("firsts")
    w = Window.partitionBy(*by).orderBy("dist", F.col("p")["place_id"])
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_k(origins: DataFrame, places: DataFrame, k: int = 5) -> DataFrame:
    """k nearest places of each origin (lat0, lon0) with distance and azimuth (see ``_ring_candidates``)."""
    o = _with_cell(origins.where(F.col("lat0").isNotNull() & F.col("lon0").isNotNull()), "lat0", "lon0")
    cand = _ring_candidates(o.select(*_CELL).distinct(), coordinates(places, k), k)
    m = o.join(cand, _CELL).withColumn("dist", haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")))
    return _top_places(m, ["lat0", "lon0"], k).select(
        "lat0", "lon0", "rank", F.col("p.place_id").alias("place_id"), F.col("p.name").alias("name"),
        "dist", bearing_deg(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")).alias("azimuth"))


def nearest_in_sector(origins: DataFrame, places: DataFrame, k: int = 3, width: int = 5) -> DataFrame:
    """k nearest places of each origin in each azimuth sector; places under 100 m are skipped."""
    m = _measured(origins, coordinates(places, k)).where(F.col("dist") >= 0.1)
    m = m.withColumn("sector", F.explode(sectors_of(F.col("azimuth"), width)))
    return _top_places(m, ["lat0", "lon0", "sector"], k).select(
        "lat0", "lon0", "sector", "rank", F.col("p.place_id").alias("place_id"),
        F.col("p.name").alias("name"), F.col("p.is_admin").alias("is_admin"), "lat", "lon", "dist")


def distance_weight(dist: Column, max_km: Column) -> Column:
    ratio = dist / max_km
    return (
        F.when(max_km <= 0, 0.5).when(ratio < 0.1, 3.0).when(ratio < 0.5, 1.5).otherwise(0.5)
    )


def sector_weights(origins: DataFrame, places: DataFrame, width: int = 5) -> DataFrame:
    """Weight of each non-empty sector of each (lat0, lon0, max_km): sum of distance weights, +5 if
    any place is near. Administrative places carry no weight."""
    m = _measured(origins, coordinates(places, 1)).where((F.col("dist") >= 0.1) & (F.col("n_plain") > 0))
    m = m.withColumn("sector", F.explode(sectors_of(F.col("azimuth"), width)))
    wgt = distance_weight(F.col("dist"), F.col("max_km"))
    return (
        m.groupBy("lat0", "lon0", "max_km", "sector")
        .agg(F.sum(wgt * F.col("n_plain")).alias("_w"), F.max(wgt >= 3.0).alias("_near"))
        .select("lat0", "lon0", "max_km", "sector",
                (F.col("_w") + F.when(F.col("_near"), 5.0).otherwise(0.0)).alias("weight"))
    )


# ---------------------------------------------------------------------------------------------
# exact pruning by cells
# ---------------------------------------------------------------------------------------------

#: Cells are cubes in the space around the unit sphere, so that neither poles nor the 180th meridian are borders. A
#: cell of level n has the edge 2 ** -n: 12 km at the finest level; at the coarsest, 27 cells hold everything.
FINEST, COARSEST = 9, -1
_CELL = ["cx", "cy", "cz"]
_KEY = ["level", "kx", "ky", "kz"]


def _with_cell(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """With the finest cell of each row."""
    return df.withColumns({c: F.floor(v * 2 ** FINEST) for c, v in zip(_CELL, unit_vector(F.col(lat), F.col(lon)))})


def _coarser(df: DataFrame) -> DataFrame:
    """The cell of the row's level that holds its finest cell."""
    edge = F.pow(F.lit(2.0), F.lit(FINEST) - F.col("level"))
    return df.withColumns({k: F.floor(F.col(c) / edge) for k, c in zip(_KEY[1:], _CELL)})


def _around(df: DataFrame) -> DataFrame:
    """Each row once for its cell and the 26 around it."""
    df = df.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(26))))
    return df.withColumns({k: F.col(k) + F.floor(F.col("_o") / 3 ** i) % 3 - 1 for i, k in enumerate(_KEY[1:])}).drop("_o")


def _ring_candidates(cells: DataFrame, coords: DataFrame, k: int) -> DataFrame:
    """The coordinates that can be among the ``k`` nearest of any origin in each of the finest ``cells``.

    The rings widen from level to level. Where the cell around an origin holds k places, the k-th nearest is no
    farther than its diagonal, less than the edge of the next coarser level: that cell and the 26 around it
    are then searched. The level comes from counts, by one equi-join; the search is another. By the triangle
    inequality only coordinates no farther from the cell's centre than the k-th one there plus twice the
    cell's half diagonal remain.
    """
    levels = F.explode(F.sequence(F.lit(COARSEST), F.lit(FINEST))).alias("level")
    keyed = _coarser(_with_cell(coords, "lat", "lon").select("*", levels))
    rich = keyed.groupBy(*_KEY).agg(F.sum(F.size("firsts")).alias("_n")).where(F.col("_n") >= k).drop("_n")
    found = _coarser(cells.select("*", levels)).join(rich, _KEY, "left_semi").groupBy(*_CELL).agg(F.max("level").alias("level"))
    look = cells.join(found, _CELL, "left").withColumn("level", F.greatest(F.coalesce(F.col("level") - 1, F.lit(COARSEST)), F.lit(COARSEST)))
    edge = 2.0 ** -FINEST
    mids = [(F.col(c) + 0.5) * edge for c in _CELL]
    away = F.sqrt(sum((m - v) * (m - v) for m, v in zip(mids, unit_vector(F.col("lat"), F.col("lon")))))
    cand = _around(_coarser(look)).join(keyed.drop(*_CELL), _KEY).withColumn("_d", away)
    w = Window.partitionBy(*_CELL).orderBy("_d")
    cand = cand.withColumn("_kth", F.nth_value("_d", k).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    slack = edge * 3 ** 0.5 * 1.000001  # twice the half diagonal
    return cand.where(F.col("_kth").isNull() | (F.col("_d") <= F.col("_kth") + slack)).select(*_CELL, *coords.columns)


def nearest_place(points: DataFrame, places: DataFrame, lat: str, lon: str) -> DataFrame:
    """Adds place_id, name, dist of the nearest place of each point (ties: lowest place_id; none: null).

    The candidates are found once per occupied cell; the points meet just those by an equi-join.
    """
    pts = cut_lineage(_with_cell(points, lat, lon), "projected")
    occupied = pts.select(*_CELL).where(F.col("cx").isNotNull() & F.col("cz").isNotNull()).distinct()
    cand = _ring_candidates(occupied, coordinates(places, 1), 1).groupBy(*_CELL).agg(
        F.collect_list(F.struct(F.col("lat").alias("_plat"), F.col("lon").alias("_plon"), F.col("firsts")[0].alias("_p"))).alias("_cands"))
    scored = F.transform("_cands", lambda c: F.struct(
        haversine_km(F.col(lat), F.col(lon), c["_plat"], c["_plon"]).alias("dist"),
        c["_p"]["place_id"].alias("place_id"), c["_p"]["name"].alias("name")))
    return (
        pts.join(cand, _CELL, "left").withColumn("_best", F.array_min(scored))
        .select(*points.columns, F.col("_best.place_id").alias("place_id"),
                F.col("_best.name").alias("name"), F.col("_best.dist").alias("dist"))
    )


def within_radius(points: DataFrame, places: DataFrame, lat: str, lon: str, km: float) -> DataFrame:
    """(point, place) rows no farther apart than ``km``, anywhere on the globe: equi-join on cells, then the exact test.

    Coordinates, not places, are joined; the places of a coordinate are attached afterwards only by
    callers that need their names (see ``attach_places``). The cells' edge is the radius, so a point's partners lie in its cell and
    those around; only those that the ball around a coordinate reaches get a copy of it. The straight distance of the unit vectors
    decides, and the great-circle distance only where that is within 1e-12 (6 micrometres) of the limit.
    """
    edge = chord(km) * 1.000001
    at = lambda df, la, lo, *to: df.withColumns({k: v for to_k, key, u in zip(to, _KEY[1:], unit_vector(F.col(la), F.col(lo)))
                                                 for k, v in ((to_k, u), (key, F.floor(u / edge)))})
    coords = places.select(F.col("lat").alias("plat"), F.col("lon").alias("plon")).distinct()
    here, there = ["_ux", "_uy", "_uz"], ["_vx", "_vy", "_vz"]
    copies = _around(at(coords, "plat", "plon", *there))
    gaps = [F.greatest(F.col(k) * edge - F.col(v), F.col(v) - (F.col(k) + 1) * edge, F.lit(0.0)) for k, v in zip(_KEY[1:], there)]
    copies = copies.where(sum(g * g for g in gaps) <= edge * edge)
    d = haversine_km(F.col(lat), F.col(lon), F.col("plat"), F.col("plon"))
    row = F.abs(F.col(lat) - F.col("plat")) <= km / KM_PER_DEGREE * 1.02  # cheap test ahead of the others
    square = sum((F.col(u) - F.col(v)) * (F.col(u) - F.col(v)) for u, v in zip(here, there))
    far, near = (chord(km) + 1e-12) ** 2, max(chord(km) - 1e-12, 0.0) ** 2
    within = F.when(square > far, False).when(square < near, True).otherwise(d <= km)
    return at(points, lat, lon, *here).join(copies, _KEY[1:]).where(row & within).withColumn("dist", d).drop(*_KEY[1:], *here, *there)


def attach_places(df: DataFrame, places: DataFrame) -> DataFrame:
    """Expand coordinates (plat, plon) into the places there.

    Rows are brought together by coordinate, in order: the same places then follow each other, and a written
    result takes a fraction of the room. Before that it is coordinates, not places, that are moved.
    """
    p = places.select(F.col("lat").alias("plat"), F.col("lon").alias("plon"), "place_id",
                      F.col("name").alias("place"))
    return df.join(p.hint("merge"), ["plat", "plon"])


def corridor_samples(points: DataFrame, key: str, step_km: float = 2.0) -> DataFrame:
    """Points interpolated along each step of a path: about one per ``step_km``, two steps at least.

    Input rows carry ``prev`` (struct lat, lon of the preceding point) from ``previous_row``. A path
    of one point yields that point. The steps of a path come into one partition before they become samples, so that
    what is distinct by path afterwards needs no shuffle.
    """
    la, lo = F.col("prev.lat"), F.col("prev.lon")
    d = haversine_km(la, lo, F.col("lat"), F.col("lon"))
    steps = F.greatest(F.lit(2), F.floor(d / step_km).cast("int"))
    seg = points.where(F.col("prev").isNotNull()).select(
        key, la.alias("_la"), lo.alias("_lo"), "lat", "lon", steps.alias("_n"))
    sizes = points.groupBy(key).agg(F.count("*").alias("_c"), F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    single = sizes.where(F.col("_c") == 1).select(
        key, F.col("lat").alias("_la"), F.col("lon").alias("_lo"), "lat", "lon", F.lit(0).alias("_n"))
    seg = seg.unionByName(single).repartition(key).withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    f = F.when(F.col("_n") > 0, F.col("_t") / F.col("_n")).otherwise(0.0)
    return seg.select(key, (F.col("_la") + (F.col("lat") - F.col("_la")) * f).alias("slat"),
                      (F.col("_lo") + (F.col("lon") - F.col("_lo")) * f).alias("slon"))


def _dyadic(lo: Column, hi: Column, top: int) -> Column:
    """Keys of the aligned stretches of 2 ** level whole numbers, two of a level at most, that make up lo..hi."""
    def of_level(l):
        a, b = -F.call_function("shiftright", -lo, l), F.call_function("shiftright", hi + 1, l)
        return F.array(F.when((a < b) & (a % 2 != 0), a * 64 + l), F.when((a < b) & (b % 2 != 0), (b - 1) * 64 + l))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top)), of_level)), lambda k: k.isNotNull())


def _box_totals(boxes: DataFrame, places: DataFrame, step: float) -> DataFrame:
    """Number and lowest id of the places in each box, by sums over aligned rectangles.

    A side of length m is made up of at most 2 log m aligned stretches, so a box is of 4 log m * log m rectangles, and a place
    lies in one rectangle of each pair of levels: the work follows boxes plus places, not the pairs of them. Stretches of
    latitude without places are left out before they are paired with those of longitude. Boxes travel as numbers.
    """
    spark = boxes.sparkSession
    whole = lambda c: F.round(F.col(c) * round(1 / step)).try_cast("long")
    keys = boxes.columns
    b = boxes.withColumns({f"_{c}": whole(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")})
    b = cut_lineage(b.withColumn("_box", F.monotonically_increasing_id()), "boxes")
    *tops, rows = b.agg(*[F.max(F.floor(F.log2(F.col(f"_max_{c}") - F.col(f"_min_{c}") + 1))) for c in ("lat", "lon")], F.count("*")).first()
    sides = [("_y", "lat", int(tops[0] or 0)), ("_x", "lon", int(tops[1] or 0))]
    p = places.groupBy(whole("lat").alias("_lat"), whole("lon").alias("_lon")).agg(
        F.count("*").alias("n"), F.min("place_id").alias("first_place"))
    parts = max(spark.sparkContext.defaultParallelism, -(-rows // BOXES_A_TASK))
    r = b.drop(*keys).repartition(parts).select(
        "_box", *[_dyadic(F.col(f"_min_{c}"), F.col(f"_max_{c}"), top).alias(k) for k, c, top in sides])
    for k, c, top in sides:
        p = p.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn(
            k, F.call_function("shiftright", F.col(f"_{c}"), F.col("_l")) * 64 + F.col("_l"))
    total = [F.sum("n").alias("n"), F.min("first_place").alias("first_place")]
    p = cut_lineage(p.groupBy("_y", "_x").agg(*total), "rectangles")
    r = _meet(r.withColumn("_y", F.explode("_y")), p.select("_y").distinct(), ["_y"], "left_semi")
    r = _meet(r.withColumn("_x", F.explode("_x")), p, ["_y", "_x"]).groupBy("_box").agg(*total)
    return b.select("_box", *keys).join(r.hint("merge"), "_box").groupBy(*keys).agg(*total)


def _meet(exploded: DataFrame, known: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join of exploded rows, whose number Spark's estimate misses: ``known`` is broadcast if it has few rows, the other side never."""
    known = F.broadcast(known) if fits_broadcast(known, BROADCAST_KEYS) else known.hint("merge")
    return exploded.join(known, on, how)


def places_in_boxes(boxes: DataFrame, places: DataFrame, deg: float = CELL_DEG, totals: float | None = None) -> DataFrame:
    """Places inside each (min_lat, max_lat, min_lon, max_lon): equi-join on covered cells.

    With ``totals``, the step in degrees that bounds and coordinates are multiples of, one row for each distinct box with places
    instead: their number ``n`` and lowest id ``first_place``, without making the pairs.
    """
    if totals is not None:
        return _box_totals(boxes, places, totals)

    def span(lo: str, hi: str):
        return F.sequence(F.floor(F.col(lo) / deg).cast("int"), F.floor(F.col(hi) / deg).cast("int"))

    b = boxes.withColumn("cy", F.explode(span("min_lat", "max_lat"))) \
        .withColumn("cx", F.explode(span("min_lon", "max_lon")))
    cy, cx = cell(F.col("lat"), F.col("lon"), deg)
    p = places.withColumn("cy", cy).withColumn("cx", cx)
    inside = F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(
        F.col("min_lon"), F.col("max_lon"))
    return b.join(p, ["cy", "cx"]).where(inside).drop("cy", "cx")


def place_lookup(df: DataFrame, places: DataFrame, name_col: str = "place") -> DataFrame:
    """Attach lat/lon by exact place name (case-insensitive)."""
    p = places.select(F.lower("name").alias("_k"), "lat", "lon").dropDuplicates(["_k"])
    return df.withColumn("_k", F.lower(name_col)).join(checked_broadcast(p), "_k", "left").drop("_k")
