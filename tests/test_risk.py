"""k-map and delta on populations small enough to count by hand, and by brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from crowdcover.catalogue import CATALOGUE, Knowledge, Qid, custom
from crowdcover.operators import kmap
from crowdcover.operators.assess import Threshold, assess, bad_values, constraints, summary
from crowdcover.operators.population import Population, Scope

ROWS = ([(1970, 100, "C", "Zwolle")] * 10 + [(1971, 100, "C", "Zwolle")] * 3
        + [(1850, 300, "G", "Zwolle")] + [(1970, 100, None, "Zwolle")] * 5
        + [(1970, 100, "C", "Deventer")] * 20)
QIDS = [Qid(k, CATALOGUE[k]) for k in ("bouwjaar", "oppervlakte", "energielabel", "gemeente")]
SCHEMA = "record_id int, bouwjaar string, oppervlakte string, energielabel string, gemeente string"


@pytest.fixture(scope="module")
def pop(spark):
    return Population(spark.createDataFrame(
        ROWS, "bouwjaar__yr int, oppervlakte__m2 int, energielabel__cat string, "
              "gemeente__cat string"))


def run(spark, pop, rows, **kw):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    kw.setdefault("threshold", Threshold())
    return {r.record_id: r for r in assess(df, QIDS, pop, **kw).collect()}


def test_counts_by_hand(spark, pop):
    r = run(spark, pop, [("1970", "100", "C", "Zwolle"), ("1850", "300", "G", "Zwolle"),
                         ("1970-1971", "100", "C", "Zwolle"), ("1970", "100", None, "Zwolle"),
                         ("1970", "100", "C", None), ("2020", "100", "C", "Zwolle"),
                         ("1970", "100", "C|G", "Zwolle|Deventer"),
                         ("onbekend", "?", "-", "")])
    assert [r[i].k_populatie for i in range(8)] == [10, 1, 13, 15, 30, 0, 30, 39]
    assert [r[i].status for i in (0, 1, 2, 5)] == ["risico", "risico", "ok", "geen_match"]
    assert r[5].delta == float("inf") and r[5].risico == 1.0
    assert r[0].redenen == "k=10 < 11"


@pytest.mark.parametrize("strategy", ["direct", "blocks"])
def test_unknown_matches(spark, pop, strategy):
    r = run(spark, pop, [("1970", "100", "C", "Zwolle"), ("1970", "100", "G", "Zwolle")],
            unknown_matches=True, strategy=strategy)
    assert [r[i].k_populatie for i in (0, 1)] == [15, 5]


def test_scope_and_exclusion(spark, pop):
    q = [("1970", "100", None, None)]
    assert run(spark, pop.within(Scope({"gemeente__cat": {"Deventer"}})), q)[0].k_populatie == 20
    out = pop.within(Scope(exclude={"energielabel__cat": {"C"}}))
    assert run(spark, out, q)[0].k_populatie == 5      # an unknown label is kept
    assert pop.within(Scope({"energielabel__cat": (None, None)})).size() == 34
    with pytest.raises(ValueError):
        Scope({"a": {"x"}}) & Scope({"a": {"y"}})
    with pytest.raises(KeyError):
        pop.within(Scope({"nope": {"x"}})).rows()


def test_delta_and_inconsistency(spark, pop):
    rows = [("1850", "300", "G", "Zwolle")] * 2 + [("1970-1971", "100", "C", "Zwolle")] * 3
    r = run(spark, pop, rows, threshold=Threshold.norm(0.09, sensitive=True))
    assert r[0].delta == 2 and "more records" in r[0].redenen
    assert r[2].delta == pytest.approx(3 / 13) and r[2].status == "risico"
    assert {r[i].klasse for i in (2, 3, 4)} == {2}


def test_threshold():
    assert Threshold(0.09).k == 11 and Threshold(0.08).k == 12 and Threshold(0.05).k == 20
    for p in (0.04, 0.34):
        with pytest.raises(ValueError):
            Threshold(p)


def test_estimated_share(spark, pop):
    df = spark.createDataFrame(
        [(0, "1970", "heatpump"), (1, "1970", "boiler"), (2, "1970", "boiler"), (3, "1970", None)],
        "record_id int, bouwjaar string, toestel string")
    qids = [Qid("bouwjaar", CATALOGUE["bouwjaar"]), Qid("toestel", CATALOGUE["toestel"])]
    r = {x.record_id: x for x in assess(df, qids, pop, scenario=Knowledge.INSIDER).collect()}
    assert [round(r[i].k, 6) for i in range(4)] == [round(35 / 3, 6), round(70 / 3, 6),
                                                     round(70 / 3, 6), 35.0]
    assert r[0].k_geschat
    plain = assess(df, qids, pop).collect()
    assert {x.k for x in plain} == {35.0} and not plain[0].k_geschat


def test_summary(spark, pop):
    df = spark.createDataFrame([(0, "1970", "100", "C", "Zwolle"), (1, "1850", "300", "G", "Zwolle"),
                                (2, "2020", "1", "A", "X"), (3, "1970-1971", "100", "C", "Zwolle")],
                               SCHEMA)
    s = summary(assess(df, QIDS, pop)).first()
    assert (s.records, s.ok, s.risico, s.geen_match) == (4, 1, 2, 1)
    assert (s.k_min, s.k_mediaan, s.delta_max, s.delta_signalen) == (1.0, 10.0, 1.0, 1)


def test_bad_values_listed(spark):
    df = spark.createDataFrame([(0, "1970", "x", "C", "Z"), (1, "oud", "100", "C", "Z")], SCHEMA)
    got = {(r.record, r.column, r.value) for r in bad_values(df, QIDS, "record_id").collect()}
    assert got == {(0, "oppervlakte", "x"), (1, "bouwjaar", "oud")}


def brute(constraint_rows, rows, unknown_matches):
    def fits(c, v):
        if c is None:
            return True
        if v is None:
            return unknown_matches
        if c["vals"] is not None:
            return str(v) in c["vals"]
        return (c["lo"] is None or v >= c["lo"]) and (c["hi"] is None or v <= c["hi"])

    return [sum(all(fits(c, v) for c, v in zip(cs, row)) for row in rows)
            for cs in constraint_rows]


@pytest.mark.parametrize("unknown_matches", [False, True])
@pytest.mark.parametrize("strategy,limit", [("direct", 65536), ("blocks", 65536), ("direct", 4),
                                            ("blocks", 4)])
def test_against_brute_force(spark, monkeypatch, strategy, limit, unknown_matches):
    """Both join strategies, with interval codes as constants and by distributed ranks."""
    rnd = random.Random(3)
    rows = [(rnd.choice([None, *range(1900, 2000)]), rnd.choice([None, *map(float, range(40, 200))]),
             rnd.choice([None, "A", "B", "C"]), rnd.choice(["X", "Y"])) for _ in range(800)]

    def number(lo, hi):
        a, b = sorted((rnd.randint(lo, hi), rnd.randint(lo, hi)))
        return rnd.choice([None, str(a), f"{a}-{b}", f"<{a}", f">={b}", f"{a}-{b}"])

    recs = [(i, number(1895, 2003), number(35, 205), rnd.choice([None, "A", "A|B", "C/A"]),
             rnd.choice([None, "X", "Y", "Z"])) for i in range(150)]
    pop = Population(spark.createDataFrame(
        rows, "bouwjaar__yr int, oppervlakte__m2 double, energielabel__cat string, "
              "gemeente__cat string"))
    df = spark.createDataFrame(recs, SCHEMA)
    monkeypatch.setattr(kmap, "MARKS_LIMIT", limit)
    got = {r.record_id: r.k_populatie for r in assess(
        df, QIDS, pop, unknown_matches=unknown_matches, strategy=strategy).collect()}
    cons = [[r[f"c{i}"] for i in range(4)]
            for r in constraints(df, QIDS, "record_id").orderBy("record_id").collect()]
    assert [got[i] for i in range(150)] == brute(cons, rows, unknown_matches)


def test_numeric_only_and_none(spark, pop):
    df = spark.createDataFrame([(0, "1850-1970"), (1, None)], "record_id int, bouwjaar string")
    q = [Qid("bouwjaar", CATALOGUE["bouwjaar"])]
    for s in ("direct", "blocks"):
        r = {x.record_id: x.k_populatie for x in assess(df, q, pop, strategy=s).collect()}
        assert r == {0: 36, 1: 39}
    assert {x.k_populatie for x in assess(df, [], pop).collect()} == {39}
    extra = Qid("bouwjaar", custom("x", "numeric"))
    assert {x.k_populatie for x in assess(df, [extra], pop, scenario=Knowledge.INSIDER).collect()
            } == {39}


def test_interval_codes_are_exact():
    """The code of x lies within the codes of lo and hi exactly when lo <= x <= hi."""
    lows, highs = [1, 3, 5, 5.5], [2, 3, 5, 9]

    def code(x):
        return sum(v <= x for v in lows) + sum(v < x for v in highs)

    xs = [0, 1, 1.5, 2, 2.5, 3, 4, 5, 5.2, 5.5, 6, 9, 10]
    for lo, hi, x in itertools.product(lows, highs, xs):
        if lo <= hi:
            assert (code(lo) <= code(x) <= code(hi)) == (lo <= x <= hi)


def test_cells_and_stopped_stations(spark):
    """A cell is counted at its own level; a stopped station as its successor, unless the
    population still has it."""
    from crowdcover.operators.resolve import resolve

    rows = [("4:1:1", "5:2:2", "215")] * 3 + [("4:1:2", "5:2:3", "260")] * 2
    base = spark.createDataFrame(rows, "h3_r4__str string, h3_r5__str string, knmi_station__cat string")
    df = spark.createDataFrame([(1, "5:2:2", "210"), (2, "5:2:3", "06260"), (3, None, None)],
                               "record_id int, zone string, station string")
    zone, station = Qid("zone", CATALOGUE["h3_cel"]), Qid("station", CATALOGUE["knmi_station"])
    got = {r.record_id: r.k_populatie for r in assess(df, [zone, station], Population(base)).collect()}
    assert got == {1: 3, 2: 2, 3: 5}
    _, notes = resolve(df, [zone, station], Population(base), "record_id")
    assert len(notes) == 1 and "successor" in notes[0]
    old = Population(base.union(spark.createDataFrame([("4:9:9", "5:9:9", "210")])))
    got = {r.record_id: r.k_populatie for r in assess(df, [station], old).collect()}
    assert got[1] == 1
    empty = df.withColumn("zone", F.lit(None).cast("string"))
    assert {r.k_populatie for r in assess(empty, [zone], Population(base)).collect()} == {5}


def test_k_histogram_counts_fractional_k(spark):
    from crowdcover.operators.report import k_histogram
    values = [0.0, 10.0, 10.5, 11.0, 30.0, 30.5, 31.0, 100.9, 1000.5, 1e9, None, float("nan")]
    rows = k_histogram(spark.createDataFrame([(v,) for v in values], "k double"), 11).collect()
    got = [r["records"] for r in sorted(rows, key=lambda r: r["klasse_nr"])]
    assert sum(got) == len(values) and got == [5, 3, 2, 0, 1, 1]


def test_one_full_key_among_many_goes_by_blocks(spark, monkeypatch):
    """What one combination of categories holds decides, not the mean over all of them."""
    from crowdcover.operators import kmap
    rnd = random.Random(5)
    rows = [("hot" if i % 3 == 0 else f"c{i % 40}", rnd.randrange(500), rnd.randrange(500)) for i in range(3000)]
    pop = spark.createDataFrame(rows, "seg string, a int, b int")
    rules = [(i, "hot", *sorted((rnd.randrange(500), rnd.randrange(500))), rnd.randrange(500)) for i in range(300)]
    rules += [(1000 + k, f"c{k}", 0, 499, 0) for k in range(40)]
    classes = spark.createDataFrame(rules, "k int, s string, lo int, hi int, blo int").selectExpr(
        "k", "named_struct('lo', CAST(NULL AS DOUBLE), 'hi', CAST(NULL AS DOUBLE), 'vals', array(s)) AS c0",
        "named_struct('lo', CAST(lo AS DOUBLE), 'hi', CAST(hi AS DOUBLE), 'vals', CAST(NULL AS array<string>)) AS c1",
        "named_struct('lo', CAST(blo AS DOUBLE), 'hi', CAST(NULL AS DOUBLE), 'vals', CAST(NULL AS array<string>)) AS c2")
    slots = [kmap.Slot("c0", "seg", False), kmap.Slot("c1", "a", True), kmap.Slot("c2", "b", True)]
    used = []
    plain = kmap._in_blocks
    monkeypatch.setattr(kmap, "_in_blocks", lambda *x: used.append(1) or plain(*x))
    monkeypatch.setattr(kmap, "PER_KEY", 100)      # the mean over the keys is 8
    want = {k: n for k, s, lo, hi, blo in rules
            if (n := sum(t == s and lo <= a <= hi and b >= blo for t, a, b in rows))}
    got = {r.k: r.n for r in kmap.count(classes, pop, slots, key="k").collect()}
    assert got == want and used
    # and the rows themselves, each by itself
    single = kmap.count(classes, pop, slots, key="k", by=["a", "b"], rows=True).collect()
    assert sum(r.n for r in single) == sum(want.values()) and all(r.n == 1 for r in single)
