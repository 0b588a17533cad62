"""Matching series: bounds, exact distances, what is compared at all, and entities that are too short."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdcover.operators import matching, surfaces, trace

START = dt.datetime(2024, 1, 1)


def frame(spark, series, keys, value):
    """(keys, time, value) of {key tuple: {hour: value}}."""
    rows = [(*k, START + dt.timedelta(hours=h), v) for k, s in series.items() for h, v in s.items()]
    return spark.createDataFrame(rows, [*keys, "time", value]).repartition(3)


def plain_distance(v, x, trim):
    d = sorted(abs(v[h] - x[h]) for h in v.keys() & x.keys())
    if not d:
        return None
    kept = d[:max(int(len(v) * (1 - trim)), 1)]
    return math.sqrt(sum(y * y for y in kept) / len(kept)), sum(y <= 0.06 for y in d) / len(d)


def world(rng, n_candidates, hours, gaps):
    """Candidates whose days differ, and entities that follow one of them, more or less."""
    cands = {}
    for c in range(n_candidates):
        day = [rng.gauss(0, 3) for _ in range(hours // 24 + 1)]
        cands[(f"c{c:02}",)] = {h: round(8 + 4 * math.sin(h / 4) + day[h // 24] + rng.gauss(0, 0.3), 1)
                                for h in range(hours) if rng.random() >= gaps * (c % 3)}
    own = {}
    for e in range(8):
        source = cands[(f"c{e % n_candidates:02}",)]
        noise = (0, 0.02, 0.5, 3)[e % 4]
        own[(e,)] = {h: v + rng.gauss(0, noise) if noise else v for h, v in source.items()
                     if rng.random() >= gaps * (e % 2)}
    return own, cands


@pytest.mark.parametrize("trim", [0.0, 0.02])
@pytest.mark.parametrize("gaps", [0.0, 0.15])
def test_nearest_is_exact(spark, trim, gaps):
    own, cands = world(random.Random(4), 12, 24 * 20 + 7, gaps)
    entities = trace._sized(frame(spark, own, ["id"], "v"), ["id"], 1)
    found = trace.best_two(matching.nearest(entities, frame(spark, cands, ["cand"], "x"), of=["id"],
                                            among=["cand"], within=["id"], trim=trim), ["id"]).collect()
    assert len(found) == 8
    for r in found:
        want = sorted((plain_distance(own[(r.id,)], x, trim)[0], c) for (c,), x in cands.items())
        assert (r.cand, r.rms, r.rms_2e) == (want[0][1], pytest.approx(want[0][0]), pytest.approx(want[1][0]))
        assert r.aandeel == pytest.approx(plain_distance(own[(r.id,)], cands[(r.cand,)], trim)[1])


def test_bounds_are_bounds(spark):
    own, cands = world(random.Random(6), 6, 24 * 30, 0.01)
    entities = trace._sized(frame(spark, own, ["id"], "v"), ["id"], 1)
    candidates = frame(spark, cands, ["cand"], "x")
    for trim in (0.0, 0.02):
        low = matching.lower_bounds(entities, candidates, ["id"], ["cand"], trim).collect()
        assert len(low) == 48 and any(r.laag > 1 for r in low)
        every = spark.createDataFrame([(r.id, r.cand) for r in low], ["id", "cand"])
        low += matching.lower_bounds(entities, candidates, ["id"], ["cand"], trim, every, 6).collect()
        assert len(low) == 96
        pairs = every
        between = matching.histograms(matching.differences(pairs, entities, candidates, ["id"], ["cand"]),
                                      ["id", "cand"], trim).collect()
        for r in low:
            assert r.laag <= plain_distance(own[(r.id,)], cands[(r.cand,)], trim)[0] + 1e-9
        for r in between:
            exact = plain_distance(own[(r.id,)], cands[(r.cand,)], trim)[0]
            assert r.laag <= exact + 1e-9 and exact <= r.hoog + 1e-9 and r.hoog - r.laag < 0.05 * exact + 1e-4


def test_few_hours_meet(spark, monkeypatch):
    """Weather varies over the map: candidates that lie far away are never compared by the hour."""
    rng, hours, side = random.Random(8), 24 * 40, 9
    slope = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(hours // 24)]
    cands = {(f"{a}{b}",): {h: 8 + 4 * math.sin(h / 4) + slope[h // 24][0] * a + slope[h // 24][1] * b
                            + rng.gauss(0, 0.3) for h in range(hours)} for a in range(side) for b in range(side)}
    own = {(e,): {h: v + rng.gauss(0, 0.2) for h, v in cands[(f"{e}{8 - e}",)].items()} for e in range(side)}
    met = []
    plain = matching.differences

    def counted(*args):
        out = plain(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(matching, "differences", counted)
    entities = trace._sized(frame(spark, own, ["id"], "v"), ["id"], 1)
    found = trace.best_two(matching.nearest(entities, frame(spark, cands, ["cand"], "x"), of=["id"],
                                            among=["cand"], within=["id"]), ["id"])
    assert {r.id: r.cand for r in found.collect()} == {e: f"{e}{8 - e}" for e in range(side)}
    assert sum(met) < 0.2 * side ** 3 * hours, met


def test_close_shares(spark):
    own, cands = world(random.Random(5), 6, 24 * 9, 0.1)
    got = {(r.id, r.cand): r.aandeel for r in matching.close_shares(
        frame(spark, own, ["id"], "v"), frame(spark, cands, ["cand"], "x"), ["id"], ["cand"]).collect()}
    want = {(e, c): plain_distance(v, x, 0)[1] for (e,), v in own.items() for (c,), x in cands.items()}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 0})


def test_ties_and_constant_series(spark):
    same = {h: 5.0 for h in range(300)}
    own = {(1,): same, (2,): {h: 6.0 for h in range(300)}}
    cands = {("b",): same, ("a",): dict(same), ("c",): {h: 5.0 + h % 2 for h in range(300)}}
    entities = trace._sized(frame(spark, own, ["id"], "v"), ["id"], 1)
    got = {r.id: (r.cand, r.rms, r.rms_2e, r.exact) for r in trace.best_two(matching.nearest(
        entities, frame(spark, cands, ["cand"], "x"), of=["id"], among=["cand"], within=["id"]), ["id"]).collect()}
    assert got[1] == ("a", 0.0, 0.0, True)
    assert got[2][0] == "c" and got[2][1] == pytest.approx(math.sqrt(144 / 294)) and got[2][2] == 1.0


STATIONS = [(n, 51.5 + 0.3 * i, 4.5 + 0.4 * (i * 3 % 5)) for i, n in enumerate("ABCDE")]


def test_short_series_keep_a_row(spark):
    rng = random.Random(2)
    ref = {(s,): {h: round(rng.gauss(8, 4), 1) for h in range(24 * 20)} for s, _, _ in STATIONS}
    own = {("long",): ref[("B",)], ("short",): {h: v for h, v in ref[("A",)].items() if h < 50}}
    series = frame(spark, own, ["id"], "v")
    reference = frame(spark, ref, ["station"], "T")
    stations = spark.createDataFrame(STATIONS, "station string, lat double, lon double")
    cells = spark.createDataFrame([(4, "4:0:0", 52.0, 5.0)], "niveau int, cand string, lat double, lon double")
    got = {r.id: r for r in trace.trace(series, reference, stations, cells).collect()}
    assert (got["long"].regime, got["long"].locatie, got["long"].uren) == ("station", "B", 480)
    assert (got["short"].regime, got["short"].locatie, got["short"].uren) == (trace.TOO_SHORT, None, 50)
    columns = {r.id: r for r in trace.as_columns(trace.trace(series, reference, stations, cells), stations).collect()}
    assert columns["short"].weerzone_h3 is None and columns["long"].weer_knmi_station == "B"
    f = trace.investigate(series, reference, stations, cells, methods=("idw2",), search_km=0.5)
    assert {r.id: r.regime for r in f.per_entity.collect()} == {"long": "station", "short": trace.TOO_SHORT}
    only_short = trace.investigate(series.where("id = 'short'"), reference, stations, cells, methods=("idw2",),
                                   search_km=0.5)
    assert [(r.id, r.regime) for r in only_short.per_entity.collect()] == [("short", trace.TOO_SHORT)]


def test_surfaces_are_solved_once_per_set(spark):
    rng = random.Random(3)
    ref = {(s,): {h: rng.gauss(8, 4) for h in range(48) if not (s == "E" and h % 2)} for s, _, _ in STATIONS}
    reference = frame(spark, ref, ["station"], "T")
    stations = spark.createDataFrame(STATIONS, "station string, lat double, lon double")
    values, members = surfaces.reporting_sets(reference, stations, "T")
    assert members.select("stel").distinct().count() == 2 and values.count() == 48 * 4 + 24
    points = spark.createDataFrame([("p", 52.1, 5.2), ("q", 51.7, 4.9)], "cand string, lat double, lon double")
    for kind in ("linear", "thin_plate", "multiquadric"):
        got = {(r.time, r.cand): r.x for r in surfaces.interpolate_rbf(reference, stations, points, kind).collect()}
        for (t, cand), x in got.items():
            h = int((t - START).total_seconds() // 3600)
            here = [s for s in STATIONS if h in ref[(s[0],)]]
            km = np.array([(lo * surfaces.geo.KM_LON, la * surfaces.geo.KM_LAT) for _, la, lo in here])
            apart = np.linalg.norm(km[:, None] - km, axis=2)
            eps = apart[apart > 0].mean()
            a = surfaces.radial(apart, kind, eps)
            v = np.array([ref[(s[0],)][h] for s in here])
            la, lo = (52.1, 5.2) if cand == "p" else (51.7, 4.9)
            to = np.array([lo * surfaces.geo.KM_LON, la * surfaces.geo.KM_LAT])
            k = surfaces.radial(np.linalg.norm(km - to, axis=1), kind, eps)
            if kind != "multiquadric":
                p = np.hstack([np.ones((len(km), 1)), km])
                a = np.block([[a, p], [p.T, np.zeros((3, 3))]])
                v, k = np.concatenate([v, np.zeros(3)]), np.concatenate([k, [1], to])
            assert x == pytest.approx(k @ np.linalg.lstsq(a, v, rcond=None)[0], abs=1e-6)
        assert len(got) == 96


def test_periods_inside_and_between_days(spark):
    hours = [dt.datetime(2024, 3, 30, 0) + dt.timedelta(hours=h) for h in range(72)]
    gap = [dt.datetime(2024, 10, d) for d in (25, 26, 28, 29)]
    got = {r.time: r for r in trace.periods(spark.createDataFrame([(t,) for t in hours + gap], "time timestamp")).collect()}
    switch = dt.datetime(2024, 3, 31, 1)
    for t in hours:
        assert got[t].period == (t >= switch) and got[t].zomer == (t >= switch)
        assert got[t].bij_wissel == (abs((t - switch).total_seconds() + 1) <= 24 * 3600)
    assert [(got[t].period, got[t].zomer) for t in gap] == [(1, True), (1, True), (2, False), (2, False)]


def test_parts_and_blocks_change_nothing(spark, monkeypatch):
    """Many small parts of entities and blocks of candidates, shifts as candidates, and groups that meet."""
    monkeypatch.setattr(matching, "PART_ROWS", 30)
    own, cands = world(random.Random(7), 9, 24 * 9 + 5, 0.1)
    moved = {(s, *c): {h - s: x for h, x in v.items() if h != 40} for c, v in cands.items() for s in (0, 1, -2)}
    counted = {(s,): {h - s: 1.0 for h in range(24 * 9 + 5) if h != 40} for s in (0, 1, -2)}
    entities = frame(spark, own, ["id"], "v").withColumn("soort", F.col("id") % 2)
    candidates = frame(spark, moved, ["shift", "cand"], "x").withColumn(
        "soort", F.substring("cand", 2, 2).cast("bigint") % 2)
    for order, trim in (("rms", matching.TRIM), ("aandeel", matching.TRIM), ("rms", 0.0)):
        got = matching.nearest(entities, candidates, of=["id"], among=["shift", "cand"], within=["id", "shift"],
                               counted=frame(spark, counted, ["shift"], "v").drop("v"), meet=["soort"], order=order,
                               least=100, trim=trim).collect()
        seen = {}
        for r in got:
            seen.setdefault((r.id, r["shift"]), []).append(r)
        assert len(seen) == 24
        for (e, s), rows in seen.items():
            v = {h: x for h, x in own[(e,)].items() if h + s in range(24 * 9 + 5) and h + s != 40}
            want = {c: plain_distance(v, moved[(s, c)], trim) for (c,) in cands if int(c[1:]) % 2 == e % 2}
            value = (lambda w: w[0]) if order == "rms" else (lambda w: -w[1])
            last = sorted(map(value, want.values()))[1]
            assert {r.cand for r in rows} == {c for c, w in want.items() if value(w) <= last + 1e-12}
            for r in rows:
                assert (r.rms, r.aandeel) == pytest.approx(want[r.cand]) and r.uren == len(v)


def test_aligned_series_are_rows_of_days(spark):
    """An hour of an entity is never a row of its own in a table that is written."""
    rng = random.Random(2)
    ref = {(s,): {h: round(rng.gauss(8, 4), 1) for h in range(24 * 20)} for s, _, _ in STATIONS}
    aligned, _ = trace.align(frame(spark, {("a",): ref[("B",)], ("b",): ref[("C",)]}, ["id"], "v"),
                             frame(spark, ref, ["station"], "T"))
    assert aligned.count() == 40 and {r.uren for r in aligned.select("uren").collect()} == {480}
