"""Counting: how many population rows satisfy every constraint of a class (k-map).

The population is reduced before it meets the classes:

1. numeric values become the number of the elementary interval they fall in (the intervals the
   bounds of the classes make), so a few codes replace millions of values;
2. rows that no class can match are left out, where possible in the scan itself;
3. one aggregation gives the *cube*: a row count per combination of codes and categories;
4. which attributes a class constrains is its *pattern*; the cube is rolled up once per pattern
   that occurs, and the pattern is a join key, so a wildcard never becomes an OR.

Classes then meet the rolled-up cube in one of two ways, both exact:

* few classes in every combination of categories (the fullest is counted): a hash join on pattern and
  categories with the interval codes as a filter; the classes are broadcast, after their number is checked;
* otherwise: every range of codes is cut into at most 2 log(n) aligned blocks, and every cube
  row is counted once under each block that holds it; the join is then on equal blocks only,
  and the counted side has one row per key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import count_le, count_lt
from ..session import cut
from .ordering import running_totals

ANY, UNKNOWN = "\u0001", "\u0002"      # text keys: not constrained, unknown in the population
ANY_CODE, UNKNOWN_CODE = -1, -2
MARKS_LIMIT = 65_536       # class bounds of one attribute that travel as a constant
VALUES_LIMIT = 2_000       # allowed values of one attribute that become an IN list
BROADCAST_ROWS = 100_000   # class rows that may be broadcast
PER_KEY = 1_000            # classes of any combination of categories that may be compared one by one
BLOCK_DIMS = 2             # numeric attributes cut into blocks


@dataclass(frozen=True)
class Slot:
    """One attribute: its constraint column in the classes, its column in the population."""

    name: str
    column: str
    numeric: bool


@dataclass(frozen=True)
class _Marks:
    lows: list
    highs: list

    def code(self, x: Column) -> Column:
        """Number of the elementary interval of ``x``: bounds at or below it, upper ones below."""
        return count_le(self.lows, x) + count_lt(self.highs, x)


def count(classes: DataFrame, population: DataFrame, slots: Sequence[Slot], *, key: str,
          by: Sequence[str] = (), unknown_matches: bool = False,
          strategy: str | None = None, rows: bool = False) -> DataFrame:
    """Rows ``(key, *by, n)``: the number of rows of ``population`` that satisfy all constraints
    of the class. Classes that match nothing have no row. ``by`` splits the counts by population
    columns. ``unknown_matches``: an unknown population value satisfies any constraint.

    ``rows``: every matching row by itself, with ``n`` 1, and nothing is aggregated: for few classes
    that match few rows, which the scan leaves out where it can."""
    slots, by = list(slots), list(by)
    classes = classes.select(key, *[s.name for s in slots]).withColumn(
        "_pattern", sum((F.col(s.name).isNotNull().cast("int") * F.lit(1 << i)
                         for i, s in enumerate(slots)), F.lit(0)))
    facts = _facts(classes, slots, unknown_matches)
    if not facts["patterns"]:
        empty = population.select(*by).limit(0)
        return classes.limit(0).select(key).join(empty, F.lit(False)).withColumn(
            "n", F.lit(0).cast("bigint"))
    marks, values = _lists(classes, slots, facts)
    cube = _cube(population, slots, by, facts, marks, values, unknown_matches, rows)
    rules, cube = _codes(classes, cube, slots, by, marks, facts)
    rolled = _rolled(cube, slots, by, facts["patterns"], rows)
    wanted = _wanted(rules, slots, key, unknown_matches)

    numeric = [i for i, s in enumerate(slots) if s.numeric]
    if strategy is None:
        few = facts["exploded"] <= BROADCAST_ROWS and (
            facts["exploded"] <= PER_KEY or _most_per_key(wanted, slots) <= PER_KEY)
        strategy = "direct" if not numeric or few else "blocks"
    if strategy == "blocks" and numeric:
        cut = numeric[:1 if rows else BLOCK_DIMS]
        levels = {i: _top(facts, i).bit_length() for i in cut}
        rolled = _with_blocks(rolled, cut, slots, by, levels, rows)
        wanted = _in_blocks(wanted, cut, unknown_matches, levels)
    else:
        cut = []
    # the planner sizes these rows by the few classes they are made of, so it is told what to do
    wanted = wanted.hint("broadcast" if not cut and facts["exploded"] <= BROADCAST_ROWS else "merge")
    on = F.col("p._pattern") == F.col("w._pattern")
    for i, s in enumerate(slots):
        if not s.numeric:
            on &= F.col(f"p.k{i}") == F.col(f"w.v{i}")
        elif i in cut:
            on &= F.col(f"p.b{i}") == F.col(f"w.b{i}")
        else:
            within = F.col(f"p.k{i}").between(F.col(f"w.from{i}"), F.col(f"w.to{i}"))
            on &= (within | (F.col(f"p.k{i}") == UNKNOWN_CODE)) if unknown_matches else within
    met = rolled.alias("p").join(wanted.alias("w"), on)
    if rows:
        return met.select(f"w.{key}", *[f"p.{c}" for c in by], F.col("p.n").cast("bigint").alias("n"))
    return (met.groupBy(f"w.{key}", *[f"p.{c}" for c in by])
            .agg(F.sum("p.n").cast("bigint").alias("n")))


def _most_per_key(wanted: DataFrame, slots) -> int:
    """How many classes the fullest combination of categories has: one such key is enough to make
    comparing them one by one too slow. Asked only while the classes are few enough to broadcast."""
    keys = [f"v{i}" for i, s in enumerate(slots) if not s.numeric]
    return wanted.groupBy("_pattern", *keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _facts(classes: DataFrame, slots, unknown_matches: bool = False) -> dict:
    """What the classes look like, in one pass: patterns, spans, and sizes to decide on. ``exploded``:
    the rows of :func:`_wanted`."""
    more = 1.0 if unknown_matches else 0.0
    cats = [s for s in slots if not s.numeric]
    exploded = F.lit(1).cast("double")
    for s in cats:
        exploded = exploded * F.when(F.col(s.name).isNull(), 1.0).otherwise(
            F.coalesce(F.size(F.col(s.name)["vals"]).cast("double"), F.lit(0.0)) + more)
    aggs = [F.collect_set("_pattern").alias("patterns"),
            F.coalesce(F.sum(exploded), F.lit(0.0)).alias("exploded")]
    for i, s in enumerate(slots):
        c = F.col(s.name)
        if s.numeric:
            aggs += [F.min(c["lo"]).alias(f"min{i}"), F.max(c["hi"]).alias(f"max{i}"),
                     F.count_if(c.isNotNull() & c["lo"].isNull()).alias(f"open_lo{i}"),
                     F.count_if(c.isNotNull() & c["hi"].isNull()).alias(f"open_hi{i}"),
                     F.approx_count_distinct(c["lo"]).alias(f"nlo{i}"),
                     F.approx_count_distinct(c["hi"]).alias(f"nhi{i}")]
        else:
            aggs += [F.approx_count_distinct(c["vals"]).alias(f"nsets{i}"),
                     F.max(F.size(c["vals"])).alias(f"widest{i}")]
    return classes.agg(*aggs).first().asDict()


def _top(facts: dict, i: int) -> int:
    """No interval code of the attribute is higher. The numbers of bounds are estimates (within
    a few per cent), so twice their sum is surely enough."""
    return 2 * (facts[f"nlo{i}"] + facts[f"nhi{i}"]) + 2


def _lists(classes: DataFrame, slots, facts) -> tuple[dict, dict]:
    """The bounds and allowed values of the attributes that have few enough of them."""
    few = {}
    for i, s in enumerate(slots):
        c = F.col(s.name)
        if s.numeric and facts[f"nlo{i}"] + facts[f"nhi{i}"] <= MARKS_LIMIT:
            few[f"lo{i}"] = F.collect_set(c["lo"])
            few[f"hi{i}"] = F.collect_set(c["hi"])
        elif not s.numeric and facts[f"nsets{i}"] * (facts[f"widest{i}"] or 0) <= VALUES_LIMIT:
            few[f"vals{i}"] = F.array_distinct(F.flatten(F.collect_set(c["vals"])))
    found = classes.agg(*[e.alias(n) for n, e in few.items()]).first().asDict() if few else {}
    marks = {i: _Marks(sorted(found[f"lo{i}"]), sorted(found[f"hi{i}"]))
             for i, s in enumerate(slots) if f"lo{i}" in found}
    values = {i: sorted(found[f"vals{i}"]) for i, s in enumerate(slots) if f"vals{i}" in found}
    return marks, values


def _cube(population, slots, by, facts, marks, values, unknown_matches, rows=False) -> DataFrame:
    """Row counts per combination of codes, categories and attributes that can match at all; with
    ``rows`` the rows themselves."""
    always = facts["patterns"][0]
    for p in facts["patterns"]:
        always &= p
    keys, possible, scan = [], F.lit(0), F.lit(True)
    for i, s in enumerate(slots):
        c = F.col(s.column)
        if s.numeric:
            c = c.cast("double")
            hit = c.isNotNull() & ~F.isnan(c)
            if not facts[f"open_lo{i}"] and facts[f"min{i}"] is not None:
                hit &= c >= F.lit(facts[f"min{i}"])
            if not facts[f"open_hi{i}"] and facts[f"max{i}"] is not None:
                hit &= c <= F.lit(facts[f"max{i}"])
            q = marks[i].code(c) if i in marks else c
        else:
            c = c.cast("string")
            hit = c.isin(*values[i]) if i in values else c.isNotNull()
            q = c
        if unknown_matches:
            hit = F.col(s.column).isNull() | hit
        hit = F.coalesce(hit, F.lit(False))
        if always >> i & 1:
            scan &= hit
        possible = possible + F.when(hit, F.lit(1 << i)).otherwise(0)
        keys.append(F.when(hit, q).alias(f"q{i}"))
    if rows:
        return population.where(scan).select(*by, *keys, possible.alias("_possible"),
                                             F.lit(1).cast("bigint").alias("n"))
    return (population.where(scan)
            .groupBy(*[F.col(c) for c in by], *keys, possible.alias("_possible"))
            .agg(F.count(F.lit(1)).alias("n")))


def _codes(classes, cube, slots, by, marks, facts) -> tuple[DataFrame, DataFrame]:
    """Class ranges as ranges of codes. Attributes with too many bounds for a constant get
    their codes from a distributed running count over all values and bounds."""
    rules = classes
    for i, s in enumerate(slots):
        if not s.numeric:
            continue
        lo, hi = F.col(s.name)["lo"], F.col(s.name)["hi"]
        if i in marks:
            first, last = marks[i].code(lo), marks[i].code(hi)
        else:
            cube = cut(cube)
            codes = cut(_rank_codes(classes, cube, s, f"q{i}"))
            as_ = [F.col("_x").alias(f"_x{i}"), F.col("_code").alias(f"_c{i}")]
            rules = (rules.withColumn(f"_l{i}", lo).withColumn(f"_h{i}", hi)
                     .join(codes.select(F.col("_x").alias(f"_l{i}"),
                                        F.col("_code").alias(f"_lc{i}")), f"_l{i}", "left")
                     .join(codes.select(F.col("_x").alias(f"_h{i}"),
                                        F.col("_code").alias(f"_hc{i}")), f"_h{i}", "left"))
            first, last = F.col(f"_lc{i}"), F.col(f"_hc{i}")
            cube = cube.join(codes.select(*as_), F.col(f"q{i}") == F.col(f"_x{i}"), "left")
            cube = (cube.groupBy(*by, *[f"_c{i}" if j == i else f"q{j}"
                                        for j in range(len(slots))], "_possible")
                    .agg(F.sum("n").alias("n")).withColumnRenamed(f"_c{i}", f"q{i}"))
        rules = (rules.withColumn(f"from{i}", F.when(F.col(s.name).isNull(), ANY_CODE)
                                  .otherwise(F.coalesce(first, F.lit(0))).cast("int"))
                 .withColumn(f"to{i}", F.when(F.col(s.name).isNull(), ANY_CODE)
                             .otherwise(F.coalesce(last, F.lit(_top(facts, i)))).cast("int")))
    return rules, cube


def _rank_codes(classes, cube, slot, q) -> DataFrame:
    c = F.col(slot.name)
    values = cube.where(F.col(q).isNotNull()).select(
        F.col(q).alias("_x"), F.lit(0).alias("_lows"), F.lit(0).alias("_highs"))
    lows = classes.select(c["lo"].alias("_x"), F.lit(1), F.lit(0)).where("_x is not null")
    highs = classes.select(c["hi"].alias("_x"), F.lit(0), F.lit(1)).where("_x is not null")
    each = (values.union(lows).union(highs).groupBy("_x")
            .agg(F.max("_lows").alias("_lows"), F.max("_highs").alias("_highs")))
    cum = running_totals(cut(each), "_x", {"_l": F.col("_lows"), "_h": F.col("_highs")})
    return cum.select("_x", (F.col("_l") + F.col("_h") - F.col("_highs")).alias("_code"))


def _rolled(cube, slots, by, patterns, single=False) -> DataFrame:
    """The cube once per pattern, with the attributes outside the pattern taken together."""
    if len(patterns) == 1:
        p = patterns[0]
        rows = cube.where(F.col("_possible").bitwiseAND(F.lit(p)) == p).withColumn(
            "_pattern", F.lit(p))
    else:
        fits = F.filter(F.lit([int(p) for p in sorted(patterns)]),
                        lambda p: F.col("_possible").bitwiseAND(p) == p)
        rows = cube.withColumn("_pattern", F.explode(fits))
    keys = []
    for i, s in enumerate(slots):
        used = F.col("_pattern").bitwiseAND(F.lit(1 << i)) != 0
        any_, unknown = (ANY_CODE, UNKNOWN_CODE) if s.numeric else (ANY, UNKNOWN)
        q = F.col(f"q{i}").cast("int") if s.numeric else F.col(f"q{i}")
        keys.append(F.when(used, F.coalesce(q, F.lit(unknown))).otherwise(F.lit(any_))
                    .alias(f"k{i}"))
    if single:
        return rows.select("_pattern", *keys, *by, "n")
    return rows.groupBy("_pattern", *keys, *by).agg(F.sum("n").alias("n"))


def _wanted(rules, slots, key, unknown_matches) -> DataFrame:
    """One row per class and allowed combination of categories."""
    out = rules
    for i, s in enumerate(slots):
        if s.numeric:
            continue
        vals = F.array_distinct(F.col(s.name)["vals"])    # once each, or rows count twice
        if unknown_matches:
            vals = F.array_append(vals, UNKNOWN)
        out = out.withColumn(f"v{i}", F.explode(
            F.when(F.col(s.name).isNull(), F.array(F.lit(ANY))).otherwise(vals)))
    cols = [f"v{i}" if not s.numeric else c for i, s in enumerate(slots)
            for c in ((f"v{i}",) if not s.numeric else (f"from{i}", f"to{i}"))]
    return out.select(key, "_pattern", *cols)


_LEVEL = 1 << 40           # a block is level * 2^40 + number; negative codes stand for themselves


def _with_blocks(rolled, cut, slots, by, levels, single=False) -> DataFrame:
    out = rolled
    for i in cut:
        k = F.col(f"k{i}").cast("bigint")
        blocks = _ancestors(k, levels[i])
        out = out.withColumn(f"b{i}", F.explode(
            F.when(k < 0, F.array(k)).otherwise(blocks))).drop(f"k{i}")
    keys = ["_pattern", *by, *[f"b{i}" for i in cut],
            *[f"k{i}" for i in range(len(slots)) if i not in cut]]
    if single:
        return out.select(*keys, "n")
    return out.groupBy(*keys).agg(F.sum("n").alias("n"))


def _ancestors(code: Column, levels: int) -> Column:
    """The aligned blocks that hold ``code``, one per level."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda lv: F.lit(_LEVEL) * lv
                       + F.floor(code / F.pow(F.lit(2.0), lv)))


def _in_blocks(wanted, cut, unknown_matches, levels) -> DataFrame:
    """Each range of codes as the aligned blocks that make it up exactly."""
    out = wanted
    for i in cut:
        lo, end = F.col(f"from{i}").cast("bigint"), F.col(f"to{i}").cast("bigint") + 1
        blocks = _blocks(lo, end, levels[i])
        if unknown_matches:
            blocks = F.array_append(blocks, F.lit(UNKNOWN_CODE).cast("bigint"))
        out = out.withColumn(f"b{i}", F.explode(
            F.when(lo < 0, F.array(lo)).otherwise(blocks))).drop(f"from{i}", f"to{i}")
    return out


def _blocks(lo: Column, end: Column, levels: int) -> Column:
    """Aligned blocks covering ``[lo, end)``: at every level at most one at either end."""
    def at(lv):
        size = F.pow(F.lit(2.0), lv)
        left, right = F.ceil(lo / size), F.floor(end / size)
        odd_left = (left < right) & (left % 2 == 1)
        rest = F.when(odd_left, left + 1).otherwise(left)
        odd_right = (rest < right) & (right % 2 == 1)
        base = F.lit(_LEVEL) * lv
        return F.filter(F.array(F.when(odd_left, base + left),
                                F.when(odd_right, base + right - 1)), lambda b: b.isNotNull())

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))
