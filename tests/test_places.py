"""Cells, walls, components, signature by hand, and planted series."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdcover.functions import constraints as con
from crowdcover.functions import geo
from crowdcover.operators import detect, facade, ordering, trace
from crowdcover.operators import signature as sig


def test_cells(spark):
    rnd = random.Random(1)
    pts = [(51 + rnd.random() * 2, 4 + rnd.random() * 3) for _ in range(200)]
    df = spark.createDataFrame(pts, "la double, lo double")
    for level in (4, 6):
        d = df.withColumn("c", geo.cell(F.col("la"), F.col("lo"), level)).withColumn(
            "m", geo.cell_centre(F.col("c")))
        d = d.withColumn("again", geo.cell(F.col("m.lat"), F.col("m.lon"), level))
        assert d.where("c <> again").count() == 0
        away = np.hypot(*[np.array([r[0] for r in d.select(e).collect()]) for e in (
            (F.col("m.lat") - F.col("la")) * geo.KM_LAT, (F.col("m.lon") - F.col("lo")) * geo.KM_LON)])
        assert away.max() <= geo.edge_km(level) + 1e-9
    one = df.limit(1).select(geo.cell(F.col("la"), F.col("lo"), 5).alias("c"))
    sizes = [one.select(F.size(geo.disk(F.col("c"), k))).first()[0] for k in (0, 1, 2, 5)]
    assert sizes == [1, 7, 19, 91]
    wide = one.select(F.size(geo.widen_cells(con.one_of(F.array("c")), 10.0)["vals"])).first()[0]
    assert wide == 7
    centres = df.select(geo.cell_centre(geo.cell(F.col("la"), F.col("lo"), 6)).alias("m")).select("m.*")
    assert detect.centre_levels(centres, [("lat", "lon")]) == {("lat", "lon"): 6}
    assert detect.centre_levels(df, [("la", "lo")]) == {}


def rect(pand, x1, y1, x2, y2):
    pts = [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]
    return [(pand, 0, False, i, float(x), float(y)) for i, (x, y) in enumerate(pts)]


def test_walls_by_hand(spark):
    """Three houses: two against each other, the third a metre off."""
    v = spark.createDataFrame(rect(1, 0, 0, 6, 10) + rect(2, 6, 2, 12, 12) + rect(3, 13, 0, 19, 10),
                              "pand int, ring int, hole boolean, seq int, x double, y double")
    e = facade.edges(v)
    pairs = facade.shared_pairs(e)
    shared = {(r.pand, r.buurpand): r.lengte for r in facade.shared_walls(pairs).where("lengte > 0").collect()}
    assert shared == {(1, 2): 8.0, (2, 1): 8.0}
    ex = {r.pand: r.asDict() for r in facade.exposed_per_sector(facade.exposed_edges(e, pairs)).collect()}
    assert (ex[1]["gevel_o__m"], ex[1]["gevel_w__m"], ex[1]["gevel_n__m"]) == (2.0, 10.0, 6.0)
    assert ex[3]["gevel_w__m"] == 10.0
    n = facade.neighbours(v.select("pand").distinct(), facade.links(pairs))
    assert {r.pand: (r.buren__0, r.blok_panden__0) for r in n.collect()} == {1: (1, 2), 2: (1, 2), 3: (0, 1)}


def test_holes_are_turned(spark):
    outer = [(1, 0, False, i, x, y) for i, (x, y) in enumerate(
        [(0., 0.), (0., 10.), (10., 10.), (10., 0.), (0., 0.)])]
    hole = [(1, 1, True, i, x, y) for i, (x, y) in enumerate(
        [(2., 2.), (4., 2.), (4., 4.), (2., 4.), (2., 2.)])]
    v = spark.createDataFrame(outer + hole, "pand int, ring int, hole boolean, seq int, x double, y double")
    e = facade.edges(v).withColumn("a", (F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2)
    assert {r.ring: r.s for r in e.groupBy("ring").agg(F.sum("a").alias("s")).collect()} == {0: 100.0, 1: -4.0}


def test_components_against_union_find(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)]
    edges += [(1000, 2000 + i) for i in range(80)] + [(3000 + i, 3001 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    nodes = sorted(set(root) | {9999})
    got = facade.blocks(spark.createDataFrame([(n,) for n in nodes], "n int"),
                        spark.createDataFrame(edges, "a int, b int")).collect()
    assert {r.node: r.blok for r in got} == {n: find(n) for n in nodes}


def test_running_totals_and_quantiles(spark):
    rnd = random.Random(2)
    xs = [rnd.choice([rnd.random() * 100, float(rnd.randrange(5))]) for _ in range(700)]
    df = spark.createDataFrame([(x, i % 2) for i, x in enumerate(xs)], "x double, g int")
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r.g, r.p): r.q for r in ordering.quantiles(df, "x", probs, by=["g"]).collect()}
    for g in (0, 1):
        want = np.quantile([x for i, x in enumerate(xs) if i % 2 == g], probs)
        assert [got[g, p] for p in probs] == pytest.approx(list(want))


def test_signature_by_hand(spark):
    """A detached house of 1980 without label data, and the label-based level of the same house."""
    row = {"bouwjaar__yr": 1980, "oppervlakte__m2": 120, "woningtype__cat": "vrijstaand",
           "pand_woningen__0": 1, "opp_buitenmuur__m2": 150.0, "opp_grond__m2": 60.0,
           "opp_dak_plat__m2": 0.0, "opp_dak_schuin__m2": 80.0, "opp_scheidingsmuur__m2": 0.0,
           "energielabel__cat": "A+", "compactheid__m2_m_2": 2.0, "label_oppervlakte__m2": 130.0}
    df = spark.createDataFrame([row])
    r = sig.compute(df, "nta8800").first()
    win = 150 * 0.1894
    wall, door = 150 - win - 8.0, 8.0
    u = {"gevel": 1 / (1.3 + 0.17), "vloer": 1 / (0.52 + 0.17), "dak": 1 / (1.3 + 0.14)}
    h = wall * u["gevel"] + win * 2.9 + door * 1.4925 + 60 * 0.7 * u["vloer"] + 80 * u["dak"]
    assert r.H__W_K_1 == pytest.approx(h, abs=0.005)
    assert r.C__Wh_K_1 == pytest.approx(360 * 1000 / 3600 * 120, abs=0.05)
    assert r.tau__h == pytest.approx(360 / 3.6 * 120 / h, abs=0.0006)
    ref = spark.createDataFrame([(
        "vrijstaand", "1975–1991", "r", [1.0, 0.6, 0.4, 0.2], [2.9, 2.0, 1.4, 0.8], [3.0, 2.0, 1.4, 1.0],
        [1.0, 0.7, 0.4, 0.2], [1.2, 0.6, 0.3, 0.2], [0.85, 0.75, 0.6, 0.4], [250.0, 150.0, 80.0, 40.0],
        1.0, 0.2, 8.0, 2.5, 0.3, 0.1, 0.03, 0.25, 0.32)], sig.REFERENCE_SCHEMA)
    level2 = {"gevel": 0.4, "raam": 1.4, "deur": 1.4, "vloer": 0.4, "dak": 0.3}   # A+ is level 2
    m = {k: 1 / (1 / level2[k] + 0.15) for k in ("gevel", "vloer", "dak")} | {
        k: level2[k] * 0.9 for k in ("raam", "deur")}
    win = 150 * 0.2
    best = ((150 - win - 8) * m["gevel"] + win * m["raam"] + 8 * m["deur"] + 60 * 0.7 * m["vloer"]
            + 80 * m["dak"])
    assert sig.compute(df, "best", ref).first().H__W_K_1 == pytest.approx(best, abs=0.006)
    loss = 2.0 * 130
    ep = loss * (0.3 * m["gevel"] + 0.1 * m["raam"] + 0.03 * m["deur"] + 0.25 * 0.7 * m["vloer"]
                 + 0.32 * m["dak"])
    got = sig.compute(df, "ep", ref).first()
    assert got.H__W_K_1 == pytest.approx(ep, abs=0.006)
    assert got.C__Wh_K_1 == pytest.approx(100 * 130, abs=0.05)      # the label's own area
    assert sig.compute(df, "ep_cbag", ref).first().C__Wh_K_1 == pytest.approx(100 * 120, abs=0.05)
    fit = sig.compute(df, "passend", ref, detail=True).first()
    assert fit.H__W_K_1 == got.H__W_K_1 and fit.methode_gebruikt__cat == "ep"
    flat = spark.createDataFrame([row | {"pand_woningen__0": 2}])
    assert sig.compute(flat, "nta8800").first().H__W_K_1 is None


def test_heat_levels(spark):
    df = spark.createDataFrame([(w,) for w in (300., 250., 200., 150., 115., 40., 10.)], "w double")
    q = F.lit([250.0, 150.0, 80.0, 40.0])
    got = [r[0] for r in df.select(sig.heat_level(q, F.col("w"))).collect()]
    assert got == pytest.approx([0, 0, 0.5, 1.0, 1.5, 3, 3])


# --- tracing --------------------------------------------------------------------------------------

STATIONS = [("A", 52.0, 4.5), ("B", 52.4, 5.2), ("C", 52.8, 6.1), ("D", 51.7, 5.4), ("E", 52.2, 6.3)]


def weather(start, hours):
    rnd = random.Random(9)
    return {(s, start + dt.timedelta(hours=h)): round(8 + 5 * math.sin(h / 4) + rnd.random() * 9, 1)
            for h in range(hours) for s, _, _ in STATIONS}


@pytest.fixture(scope="module")
def month(spark):
    w = weather(dt.datetime(2024, 3, 10), 24 * 35)      # over the clock switch of 31 March
    ref = spark.createDataFrame([(s, t, v, 1.0) for (s, t), v in w.items()],
                                "station string, time timestamp, T double, Q double")
    st = spark.createDataFrame(STATIONS, "station string, lat double, lon double")
    return w, ref, st


def test_clock_time_and_station_switch(spark, month):
    w, ref, st = month
    switch = dt.datetime(2024, 3, 31, 1)
    rows = []
    for (s, t), v in w.items():
        if s == "B":                   # one home in clock time, one in UTC, one a fixed hour off
            rows += [("klok", t + dt.timedelta(hours=2 if t >= switch else 1), v), ("utc", t, v),
                     ("vast", t + dt.timedelta(hours=1), v)]
        if s == ("A" if t < dt.datetime(2024, 4, 1) else "D"):
            rows.append(("wissel", t, v))
    series = spark.createDataFrame(rows, "id string, time timestamp, v double")
    aligned, shifts = trace.align(series, ref)
    got = {(r.id, r.zomer): r["shift"] for r in shifts.collect()}
    assert got[("klok", False)] == -1 and got[("klok", True)] == -2
    assert got[("utc", False)] == got[("utc", True)] == 0 and got[("vast", True)] == -1
    found = {(r.soort, r.verschuiving): r.n for r in trace.time_findings(shifts).collect()}
    assert found == {("kloktijd", None): 1, ("utc", None): 2, ("vast", -1): 1}
    changes = trace.switches(trace.monthly_stations(aligned, ref)).collect()
    assert [(r.id, r.stations) for r in changes] == [("wissel", ["A", "D"])]


def test_rbf_reproduces_stations_and_planes(spark):
    """At a station a surface has its value; a plane through the values is a plane everywhere. Hours
    with other stations are solved apart, and hours with three stations have no surface."""
    st = spark.createDataFrame(STATIONS, "station string, lat double, lon double")
    h = [dt.datetime(2024, 1, 1, 0), dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 1, 2, 0)]
    rnd = random.Random(3)
    planted = {(t, n): 2 + la + 3 * lo if t == h[0] else rnd.random() for t in h for n, la, lo in STATIONS
               if t != h[2] or n in [s[0] for s in STATIONS[:3]]}
    ref = spark.createDataFrame([(t, n, v) for (t, n), v in planted.items()],
                                "time timestamp, station string, T double")
    at_stations = st.select(F.col("station").alias("cand"), "lat", "lon")
    away = spark.createDataFrame([("p", 52.3, 5.1)], "cand string, lat double, lon double")
    for kind in ("linear", "thin_plate", "multiquadric"):
        x = {(r.time, r.cand): r.x for r in trace.interpolate_rbf(ref, st, at_stations, kind).collect()}
        assert x == pytest.approx({k: v for k, v in planted.items() if k[0] != h[2]}, abs=1e-6)
    for kind in ("linear", "thin_plate"):
        x = {r.time: r.x for r in trace.interpolate_rbf(ref, st, away, kind).collect()}
        assert x[h[0]] == pytest.approx(2 + 52.3 + 3 * 5.1)


def test_grid_is_found(spark, month):
    """Homes with the interpolated weather of the centre of their cell."""
    w, ref, st = month
    homes = [(f"h{i}", 51.9 + 0.2 * i, 4.8 + 0.3 * i) for i in range(4)]
    cells = spark.createDataFrame(homes, "id string, la double, lo double").select(
        "id", geo.cell(F.col("la"), F.col("lo"), 4).alias("cand"))
    grid = trace.with_position(cells.select("cand").distinct().withColumn("niveau", F.lit(4)))
    x = trace.point_series("idw2", ref, st, grid)
    series = x.join(cells, "cand").select("id", "time", F.round("x", 2).alias("v"))
    f = trace.investigate(series, ref, st, grid, methods=("idw1", "idw2"), search_km=1.0)
    assert (f.choice, f.method, f.level) == ("grid", "idw2", 4)
    assert {r.id: r.locatie for r in f.per_entity.collect()} == {r.id: r.cand for r in cells.collect()}
    back = trace.onto_dataset(cells.select("id"), "id", f.per_entity, st).collect()
    assert all(r.weerzone_h3 and r.weer_knmi_station is None for r in back)


def test_blocks_of_a_chain_longer_than_any_bound(spark):
    from crowdcover.operators.facade import blocks
    n = 400
    nodes = spark.range(n + 2).toDF("node")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    got = dict(map(tuple, blocks(nodes, edges).collect()))
    assert got == {**{i: 0 for i in range(n)}, n: n, n + 1: n + 1}


def test_nearest_is_exact_at_every_size(spark):
    from crowdcover.operators.enrich import nearest
    rnd = random.Random(31)

    def km(a, b):
        p = math.radians
        h = (math.sin(p(b[0] - a[0]) / 2) ** 2 + math.cos(p(a[0])) * math.cos(p(b[0])) * math.sin(p(b[1] - a[1]) / 2) ** 2)
        return 2 * geo.EARTH_KM * math.asin(math.sqrt(h))

    points = [(i, rnd.uniform(50, 54), rnd.uniform(3, 8)) for i in range(150)] + [
        (200, -33.0, 151.0), (201, 0.0, 0.0), (202, -0.01, 179.99), (203, 70.0, -179.9), (204, None, 5.0), (205, 52.0, 5.0)]
    for n in (1, 3, 400):
        places = [(f"s{k:03}", rnd.uniform(50, 54), rnd.uniform(3, 8)) for k in range(n)] + [
            ("far", -35.0, 149.0), ("line", 0.5, -179.5)][:n]
        got = nearest(spark.createDataFrame(points, "id int, lat__degN double, lon__degE double"), spark.createDataFrame(
            places + places[:1], "knmi_station string, lat double, lon double"))
        assert got.count() == len(points)
        for r in got.collect():
            if r.lat__degN is None:
                assert r.knmi_station__cat is None and r.afstand__km is None
                continue
            want = min((km((r.lat__degN, r.lon__degE), (la, lo)), s) for s, la, lo in places)
            assert r.afstand__km == pytest.approx(want[0]) and r.knmi_station__cat == want[1]
    none = nearest(spark.createDataFrame(points, "id int, lat__degN double, lon__degE double"),
                   spark.createDataFrame([], "knmi_station string, lat double, lon double"))
    assert none.count() == len(points) and none.where("afstand__km is not null").isEmpty()


def test_points_meet_edges_at_borders_only(spark):
    from crowdcover.operators import spatial
    rnd = random.Random(7)

    def star(cx, cy, n, size):
        return [(cx + size * rnd.uniform(0.4, 1) * math.cos(2 * math.pi * i / n),
                 cy + size * rnd.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]

    rings = [star(5, 52, 40, 1), star(5.2, 52.1, 9, 0.3), [(3, 50), (3.5, 50), (3.5, 50.5), (3, 50.5)],
             [(4, 50), (4.1, 50.0), (4.05, 50.1)], [(-0.2, -0.2), (0.2, -0.2), (0.2, 0.2), (-0.2, 0.2)]]
    edges = [tuple(map(float, (*a, *b))) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])]
    points = [(i, rnd.uniform(3.8, 6.2), rnd.uniform(50.8, 53.2)) for i in range(1500)]
    points += [(2000 + i, 3 + 0.05 * (i % 11) + 0.013, 50 + 0.05 * (i // 11) + 0.017) for i in range(121)]
    points += [(3000, 0.0, 0.0), (3001, -0.1, 0.05), (3002, 0.25, 0.0), (3003, None, 1.0), (3004, 4.05, 50.05)]

    def plain(x, y):
        return sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for x1, y1, x2, y2 in edges) % 2 == 1

    p = spark.createDataFrame(points, "id int, x double, y double")
    e = spark.createDataFrame(edges, "x1 double, y1 double, x2 double, y2 double")
    for side in (0.05, 0.5, 7.0):
        got = {r.id: r.binnen for r in spatial.inside(p, e, "id", side=side).collect()}
        assert got == {i: x is not None and plain(x, y) for i, x, y in points}
    met = p.selectExpr("floor(y / 0.05) AS rij", "floor(x / 0.05) AS kolom").join(spatial._cells_of_edges(e, 0.05), ["rij", "kolom"])
    assert met.count() < 0.05 * len(points) * len(edges)


def test_records_without_a_whole_key_are_not_linked(spark):
    from crowdcover.operators.link import link
    from crowdcover.operators.population import Population
    pop = Population(spark.createDataFrame([("0000000000000001", 1950), ("0000000000000002", 1960), (None, 1970)],
                                           "vbo_id__str string, bouwjaar__yr int"))
    df = spark.createDataFrame([(1, "1"), (2, None), (3, "7"), (4, None)], "record_id int, bag string")
    got = {r.record_id: (r.register_bouwjaar__yr, r.register_gekoppeld__bool) for r in link(df, pop, vbo_id="bag").collect()}
    assert got == {1: (1950, True), 2: (None, False), 3: (None, False), 4: (None, False)}
