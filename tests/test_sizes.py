"""What travels to every executor, and how large an intermediate table is, at any size of the input."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from crowdcover.operators import kmap, ordering, represent
from crowdcover.operators.population import Population

SET = "struct<lo:double,hi:double,vals:array<string>>"


def test_classes_in_blocks_are_not_broadcast(spark):
    """Unknown values and blocks multiply the classes: the planner must not judge by the rows they come from."""
    classes = spark.createDataFrame(
        [(str(i), (float(i), float(i + 9), None), (None, None, ["a", "b"])) for i in range(40)] + [("z", None, (None, None, ["b"]))],
        f"_key string, c0 {SET}, c1 {SET}")
    rows = [(i % 60, "abc"[i % 3] if i % 4 else None) for i in range(600)]
    pop = spark.createDataFrame([(None if i % 60 == 7 else x, y) for i, (x, y) in enumerate(rows)], "x int, y string")
    slots = [kmap.Slot("c0", "x", True), kmap.Slot("c1", "y", False)]
    assert kmap._facts(classes.withColumn("_pattern", F.lit(3)), slots, True)["exploded"] == 40 * 3 + 2
    n = kmap.count(classes, pop, slots, key="_key", unknown_matches=True, strategy="blocks")
    assert "BroadcastHashJoin" not in n._jdf.queryExecution().executedPlan().toString()
    have = [(r.x, r.y) for r in pop.collect()]
    want = {str(i): sum((x is None or i <= x <= i + 9) and y in (None, "a", "b") for x, y in have) for i in range(40)}
    want["z"] = sum(y in (None, "b") for _, y in have)
    assert {r._key: r.n for r in n.collect()} == want


def test_omissions_are_ranked_by_text(spark):
    """Hashes are compared as they are made; no number is made of each."""
    ids = [str(i) for i in range(300)]
    limits = represent.omission_limits(spark.createDataFrame([(i,) for i in ids], "_rid string"), 70, 5, 3)
    for draw, limit in enumerate(limits):
        made = sorted(hashlib.md5(f"3|{draw}|{i}".encode()).hexdigest()[:13] for i in ids)
        assert limit == made[69]


def _number(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2 ** 32


def test_a_draw_is_hashed_once(spark):
    """No test for nulls before a join makes every hash a second time; the numbers are those of the texts."""
    ids = list(range(40))
    cells = spark.createDataFrame([("a", i, 1.0) for i in ids] + [("a", None, 1.0)], "kenmerk string, _rid bigint, x double")
    grid = spark.createDataFrame([("a", (i + 0.5) / 5, float(i * i)) for i in range(5)], "kenmerk string, p double, q double")
    counts = spark.createDataFrame([("a", "x", 30, 1), ("a", "y", 10, 1)], "kenmerk string, klasse string, pop long, ds long")
    means = represent._sampled_means(cells, grid, 3, 7, 5)
    drawn = represent.draw_categories(counts, cells, 3, 7)
    for df in (means, drawn):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("md5(cast(concat") == 1
    us = {d: [_number(7, "a", d, i) for i in ids] + [_number(7, "a", d)] for d in range(3)}
    for r in means.collect():
        assert abs(r.m - np.interp(np.array(us[r.draw]) * 5 - 0.5, range(5), [0, 1, 4, 9, 16]).mean()) < 1e-12
    first = min("xy", key=lambda c: hashlib.md5(c.encode()).hexdigest()[:13])
    end = 0.75 if first == "x" else 0.25
    got = {(r.draw, r.klasse): r.c for r in drawn.collect()}
    for d in range(3):
        assert got.get((d, first), 0) == sum(u < end for u in us[d])
        assert sum(got.get((d, c), 0) for c in "xy") == 41


def test_the_population_is_read_once(spark):
    """Moments, quantiles and distance come from one count of its values."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        read.add(1)
        return x

    values = [0.1 * (i * i % 37) if i % 9 else None for i in range(300)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "record_id long, x double")
    pop = Population(rows.select(seen("x").alias("x")))
    r = represent.compare_numbers(rows.where("record_id < 90"), pop, [represent.Feature("x")], draws=2, n_quantiles=10).first()
    assert read.value == 300
    known = np.array([x for x in values if x is not None])
    mine = np.array([x for x in values[:90] if x is not None])
    assert r.n == len(mine) and r.waarde == round((mine.mean() - known.mean()) / known.std(), 3)


def test_moments_of_counted_values(spark):
    """Equal values have no spread, also where their sum is rounded; unknown ones are no values."""
    rows = [("same", 0.1)] * 3 + [("none", None)] * 2 + [("two", 1.0), ("two", 4.0), ("two", 4.0), ("two", None)]
    cells = spark.createDataFrame(rows, "kenmerk string, x double")
    got = {r.kenmerk: (r.n, r.mu, r.sd) for r in represent._moments(represent._value_counts(cells)).collect()}
    assert got == {"same": (3, 0.1, 0.0), "none": (0, None, None), "two": (3, 3.0, 2 ** 0.5)}


def test_quantiles_of_heavy_and_single_values(spark):
    """A value that covers many ranks, and ranks between two values."""
    data = [1.0] * 50 + [2.0, 3.5] + [9.0] * 7 + [10.0]
    probs = [0.0, 0.3, 0.5, 49 / 59, 49.5 / 59, 0.85, 0.86, 0.9, 0.99, 1.0, 0.01, 0.02]
    got = ordering.quantiles(spark.createDataFrame([(x,) for x in data], "x double"), "x", probs)
    want = dict(zip(probs, np.quantile(data, probs)))
    found = {r.p: r.q for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[p] - want[p]) < 1e-9 for p in probs)
