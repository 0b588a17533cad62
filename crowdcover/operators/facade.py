"""Walls from footprints: what is exposed, which way it faces, and who the neighbours are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# Sectors of the compass, how near and how parallel a shared wall is, when a wall
# is a side, how much shared wall makes a neighbour, and the search grid.
SECTORS = ("n", "no", "o", "zo", "z", "zw", "w", "nw")
TOLERANCE_M = 0.5
MAX_SIN = 0.26
SIDE_COS = 0.7071
MIN_SHARED_M = 2.0
GRID_M = 8.0


def edges(vertices: DataFrame) -> DataFrame:
    """Directed edges with the building on their left, from a vertex table ``(pand, ring, hole,
    seq, x, y)`` of closed rings. Outer rings run counter-clockwise, holes clockwise; a ring
    with fewer than four points is no ring."""
    w = Window.partitionBy("pand", "ring").orderBy("seq")     # one ring: a handful of points
    e = vertices.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)}).where(
        F.col("x2").isNotNull())
    area = F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))
    shape = e.groupBy("pand", "ring").agg(area.alias("_area"), F.count(F.lit(1)).alias("_n"))
    e = e.join(shape.where("_n >= 3"), ["pand", "ring"])
    turn = (F.col("_area") > 0) == F.col("hole")

    def pick(a, b):
        return F.when(turn, F.col(b)).otherwise(F.col(a))

    out = e.select("pand", "ring", "seq", pick("x", "x2").alias("x1"), pick("y", "y2").alias("y1"),
                   pick("x2", "x").alias("x2"), pick("y2", "y").alias("y2"))
    return out.withColumn("lengte", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))


def shared_pairs(walls: DataFrame, *, tolerance: float = TOLERANCE_M) -> DataFrame:
    """Edge pairs of different buildings that lie along each other: ``(pand, ring, seq, buurpand,
    lengte)``, the length of the edge that the other covers.

    Edges meet in the cells of an 8 m grid. A pair that shares several cells is taken only in the
    first of them, which both edges can work out, so pairs need no removal of duplicates."""
    def low(a, b):
        return F.floor((F.least(a, b) - tolerance) / GRID_M)

    def high(a, b):
        return F.floor((F.greatest(a, b) + tolerance) / GRID_M)

    e = walls.where(F.col("lengte") > 1e-6).withColumns(
        {"i0": low("x1", "x2"), "j0": low("y1", "y2")})
    spread = e.withColumn("ci", F.explode(F.sequence(F.col("i0"), high("x1", "x2")))).withColumn(
        "cj", F.explode(F.sequence(F.col("j0"), high("y1", "y2"))))
    a, b = spread.alias("a"), spread.alias("b")
    first = ((F.col("a.ci") == F.greatest("a.i0", "b.i0"))
             & (F.col("a.cj") == F.greatest("a.j0", "b.j0")))
    pairs = a.join(b, (F.col("a.ci") == F.col("b.ci")) & (F.col("a.cj") == F.col("b.cj"))
                   & (F.col("a.pand") != F.col("b.pand"))).where(first)
    return _overlap(pairs, tolerance)


def _overlap(pairs: DataFrame, tol: float) -> DataFrame:
    length = F.col("a.lengte")
    d = pairs.select(
        F.col("a.pand").alias("pand"), F.col("a.ring").alias("ring"), F.col("a.seq").alias("seq"),
        F.col("b.pand").alias("buurpand"), length.alias("l"),
        ((F.col("a.x2") - F.col("a.x1")) / length).alias("ux"),
        ((F.col("a.y2") - F.col("a.y1")) / length).alias("uy"),
        ((F.col("b.x2") - F.col("b.x1")) / F.col("b.lengte")).alias("vx"),
        ((F.col("b.y2") - F.col("b.y1")) / F.col("b.lengte")).alias("vy"),
        *[(F.col(f"b.{c}{k}") - F.col(f"a.{c}1")).alias(f"d{c}{k}") for c in "xy" for k in (1, 2)])
    ux, uy = F.col("ux"), F.col("uy")
    d = d.where(F.abs(ux * F.col("vy") - uy * F.col("vx")) <= MAX_SIN)
    d = d.withColumns({f"s{k}": F.col(f"dx{k}") * ux + F.col(f"dy{k}") * uy for k in (1, 2)} | {
        f"n{k}": -F.col(f"dx{k}") * uy + F.col(f"dy{k}") * ux for k in (1, 2)})
    dn = F.col("n2") - F.col("n1")
    flat = F.abs(dn) < 1e-9
    t1, t2 = F.try_divide(-tol - F.col("n1"), dn), F.try_divide(tol - F.col("n1"), dn)

    def unit(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    d = d.withColumns({
        "lo": F.when(flat, 0.0).otherwise(unit(F.least(t1, t2))),
        "hi": F.when(flat, F.when(F.abs("n1") <= tol, 1.0).otherwise(0.0)).otherwise(
            unit(F.greatest(t1, t2)))})
    along = F.col("s2") - F.col("s1")
    d = d.withColumns({"sa": F.col("s1") + along * F.col("lo"),
                       "sb": F.col("s1") + along * F.col("hi")})

    def on_edge(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.col("l"), c))

    covered = on_edge(F.greatest("sa", "sb")) - on_edge(F.least("sa", "sb"))
    return d.select("pand", "ring", "seq", "buurpand", F.when(
        F.col("hi") > F.col("lo"), F.greatest(covered, F.lit(0.0))).otherwise(0.0).alias("lengte"))


def sector(ux: Column, uy: Column) -> Column:
    """Number of the 45-degree sector the outward normal of an edge faces, 0 is north."""
    azimuth = F.pmod(F.degrees(F.atan2(uy, -ux)), F.lit(360.0))
    return (F.floor((azimuth + 22.5) / 45).cast("int") % 8).cast("int")


def exposed_edges(walls: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per edge: the length not shared with another building, its sector, and whether it is a
    side (its normal along the main axis, the direction of the longest edge)."""
    shared = pairs.groupBy("pand", "ring", "seq").agg(F.sum("lengte").alias("_shared"))
    axis = walls.groupBy("pand").agg(F.max(F.struct(
        "lengte", (-F.col("ring")).alias("r"), (-F.col("seq")).alias("s"), "x1", "y1", "x2", "y2"))
        .alias("_a"))
    e = walls.where(F.col("lengte") > 1e-6).join(shared, ["pand", "ring", "seq"], "left").join(
        axis, "pand")

    def direction(p, x, y):
        length = F.col(f"{p}lengte")
        return ((F.col(f"{p}{x}2") - F.col(f"{p}{x}1")) / length,
                (F.col(f"{p}{y}2") - F.col(f"{p}{y}1")) / length)

    ux, uy = direction("", "x", "y")
    ax, ay = direction("_a.", "x", "y")
    return e.select("pand", "ring", "seq", F.greatest(
        F.col("lengte") - F.coalesce("_shared", F.lit(0.0)), F.lit(0.0)).alias("vrij"),
        sector(ux, uy).alias("sector"), (F.abs(uy * ax - ux * ay) <= SIDE_COS).alias("zij"))


def exposed_per_sector(exposed: DataFrame) -> DataFrame:
    """Per building the exposed length in each of the eight sectors, and the part that is side:
    ``gevel_n__m`` ... ``gevelzij_nw__m``."""
    def total(cond, name):
        return F.sum(F.when(cond, F.col("vrij")).otherwise(0.0)).alias(name)

    return exposed.groupBy("pand").agg(
        *[total(F.col("sector") == i, f"gevel_{s}__m") for i, s in enumerate(SECTORS)],
        *[total((F.col("sector") == i) & F.col("zij"), f"gevelzij_{s}__m")
          for i, s in enumerate(SECTORS)])


def shared_walls(pairs: DataFrame) -> DataFrame:
    """Shared wall length per pair of buildings, seen from the first."""
    return pairs.groupBy("pand", "buurpand").agg(F.sum("lengte").alias("lengte"))


def links(pairs: DataFrame, minimum: float = MIN_SHARED_M) -> DataFrame:
    """Neighbours: pairs that share enough wall seen from either side, once in each direction."""
    one = shared_walls(pairs).where(F.col("lengte") >= minimum).select(
        F.col("pand").alias("a"), F.col("buurpand").alias("b"))
    return one.union(one.select("b", "a")).distinct()


def blocks(nodes: DataFrame, edges_: DataFrame) -> DataFrame:
    """``(node, blok)``: the connected component of every node, named after its lowest id.

    Every round points each node at the lowest id among its neighbours, first towards higher
    ids, then towards lower ones; paths shorten by half or more. The minimum per node is an
    aggregation that combines before it shuffles, and joins back one row per node, so a node
    with very many neighbours is no hot group. Every round ends in a written table; the last one
    is the one that changes no edge."""
    e = cut(edges_.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v")
            .union(edges_.select(F.col("b").alias("u"), F.col("a").alias("v")).where("u != v"))
            .distinct())
    seen = None
    while True:
        low = e.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = e.join(low, "u").where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("x"), F.col("m"), "u")
        star = (small.select(F.col("x").alias("u"), F.col("m").alias("v"))
                .union(small.select("u", F.col("m").alias("v")))
                .where("u != v").distinct())
        star = cut(star)
        e = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if seen is not None and star.count() == seen.count() and star.join(
                seen, ["u", "v"], "left_anti").isEmpty():
            break
        seen = star
    root = star.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_root"))
    return nodes.select(F.col(nodes.columns[0]).alias("node")).distinct().join(
        root, "node", "left").select("node", F.coalesce("_root", "node").alias("blok"))


def neighbours(buildings: DataFrame, links_: DataFrame) -> DataFrame:
    """Per building: neighbours and the size of its block, itself included."""
    links_ = cut(links_)        # finding them is the dear part, and three branches need them
    ids = buildings.select(F.col(buildings.columns[0]).alias("node"))
    everyone = ids.union(links_.select("a")).distinct()
    block = blocks(everyone, links_)
    size = block.groupBy("blok").agg(F.count(F.lit(1)).alias("blok_panden__0"))
    count = links_.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("buren__0"))
    return (ids.distinct().join(block, "node").join(size, "blok").join(count, "node", "left")
            .select(F.col("node").alias("pand"), F.coalesce("buren__0", F.lit(0)).alias("buren__0"),
                    "blok_panden__0", "blok"))
