"""Places: counts per grid cell, points in polygons, and what known noise hides."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.numbers import gaussian

# Draws per place, and how much of the probability the heat area holds.
DRAWS = 200
HEAT_SHARE = 0.95


def counts_per(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per combination of cells, stations or regions; unknown places left out."""
    known = F.lit(True)
    for c in columns:
        known &= F.col(c).isNotNull()
    return df.where(known).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def main_station(df: DataFrame, cell: str, station: str) -> DataFrame:
    """Per cell its rows and its most frequent station (equally frequent: the lower name)."""
    pairs = df.where(F.col(cell).isNotNull()).groupBy(cell, station).agg(
        F.count(F.lit(1)).alias("n"))
    best = F.min(F.when(F.col(station).isNotNull(), F.struct((-F.col("n")).alias("n"), station)))
    return pairs.groupBy(cell).agg(F.sum("n").alias("n"), best.getField(station).alias(station))


def largest_regions(df: DataFrame, region: str, lat: str, lon: str, top: int = 22) -> DataFrame:
    """The regions with most rows, with the mean position of their rows."""
    return (df.where(F.col(region).isNotNull() & F.col(lat).isNotNull()).groupBy(region)
            .agg(F.avg(lat).alias("lat"), F.avg(lon).alias("lon"), F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), region).limit(top))


def ring_edges(rings: DataFrame, keys: Sequence[str], seq: str = "seq", x: str = "x", y: str = "y"
               ) -> DataFrame:
    """The edges of rings given as a vertex table; an open ring is closed."""
    w = Window.partitionBy(*keys).orderBy(seq)
    first = F.first(F.struct(x, y)).over(w)
    nxt = F.coalesce(F.lead(F.struct(x, y)).over(w), first)
    return rings.select(*keys, F.col(seq).alias("seq"), F.col(x).alias("x1"), F.col(y).alias("y1"),
                        nxt.alias("_n")).select("*", F.col("_n")[x].alias("x2"),
                                                F.col("_n")[y].alias("y2")).drop("_n")


def _cells_of_edges(edges: DataFrame, side: float) -> DataFrame:
    """``(x1, y1, x2, y2, rij, kolom)``: every edge in every square cell that it meets, or nearly meets."""
    tiny = 1e-9
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.select("x1", "y1", "x2", "y2", F.explode(F.sequence(
        F.floor(low / side - tiny), F.floor(high / side + tiny))).alias("rij"))
    # the part of the edge inside the row, and the columns that this part spans
    slope = F.when(F.col("y1") != F.col("y2"), (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))

    def at(y):
        return F.col("x1") + (y - F.col("y1")) * slope

    bottom, top = F.greatest(F.col("rij") * side, low), F.least((F.col("rij") + 1) * side, high)
    ends = [F.coalesce(at(bottom), F.col("x1")), F.coalesce(at(top), F.col("x2"))]
    return rows.withColumn("kolom", F.explode(F.sequence(
        F.floor(F.least(*ends) / side - tiny), F.floor(F.greatest(*ends) / side + tiny))))


def _corners(cells: DataFrame, edges: DataFrame, side: float) -> DataFrame:
    """``(rij, kolom, hoek)``: how many edges a ray to the right from the lower left corner of each cell
    crosses. Crossings are counted per cell first, then run along a row of cells."""
    e = edges.where(F.col("y1") != F.col("y2"))
    e = e.withColumn("rij", F.explode(F.sequence(F.floor(F.least("y1", "y2") / side),
                                                 F.floor(F.greatest("y1", "y2") / side) + 1)))
    line = F.col("rij") * side
    at = F.col("x1") + (line - F.col("y1")) * ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    # a crossing exactly at a corner does not lie to its right
    crossed = e.where((F.col("y1") > line) != (F.col("y2") > line)).select(
        "rij", (F.ceil(at / side) - 1).alias("kolom")).groupBy("rij", "kolom").agg(F.count(F.lit(1)).alias("n"))
    every = cells.select("rij", "kolom", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("nodig")).unionByName(
        crossed.withColumn("nodig", F.lit(False))).groupBy("rij", "kolom").agg(
            F.sum("n").alias("n"), F.max("nodig").alias("nodig"))
    to_the_right = Window.partitionBy("rij").orderBy(F.desc("kolom"))      # a row per cell of the grid
    return every.withColumn("hoek", F.sum("n").over(to_the_right)).where("nodig").select("rij", "kolom", "hoek")


def inside(points: DataFrame, edges: DataFrame, point: str, *, x: str = "x", y: str = "y",
           side: float = 0.05) -> DataFrame:
    """Which points lie inside the rings, by the even-odd rule over all rings together.

    Space is cut into square cells. For the corner of a cell it is known whether it lies inside; from
    there a path goes up and then to the right, inside the cell, and every edge on the way changes
    the answer. So points meet the edges of their own cell only, and where a cell has no edge, none."""
    at_hand = points.select(F.col(point).alias("_pt"), F.col(x).alias("_px"), F.col(y).alias("_py"),
                            F.floor(F.col(y) / side).alias("rij"), F.floor(F.col(x) / side).alias("kolom"))
    corners = _corners(at_hand.where("rij IS NOT NULL AND kolom IS NOT NULL").select("rij", "kolom").distinct(),
                       edges, side)
    px, py = F.col("_px"), F.col("_py")
    x0, y0 = F.col("kolom") * side, F.col("rij") * side
    over = F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    across = F.col("x1") + (py - F.col("y1")) * over
    rise = F.try_divide(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    height = F.col("y1") + (x0 - F.col("x1")) * rise
    # a way just right of the corner, from just above it: that settles edges that begin there
    above = (height > y0) | ((height == y0) & (rise > 0))
    below = (height < py) | ((height == py) & (rise <= 0))
    up = ((F.col("x1") > x0) != (F.col("x2") > x0)) & above & below
    right = ((F.col("y1") > py) != (F.col("y2") > py)) & (across > x0) & (across <= px)
    changes = (at_hand.join(_cells_of_edges(edges, side), ["rij", "kolom"]).groupBy("_pt").agg(
        F.sum(F.when(up, 1).otherwise(0) + F.when(right, 1).otherwise(0)).alias("_c")))
    known = at_hand.select("_pt", "rij", "kolom").join(corners, ["rij", "kolom"], "left").join(
        changes, "_pt", "left")
    odd = (F.coalesce("hoek", F.lit(0)) + F.coalesce("_c", F.lit(0))) % 2 == 1
    return (points.join(known.select("_pt", odd.alias("_b")), F.col(point) == F.col("_pt"), "left")
            .withColumn("binnen", F.coalesce("_b", F.lit(False))).drop("_pt", "_b"))


def finer_cells(cells: DataFrame, cell: str, step: int = 2) -> DataFrame:
    """The cells ``step`` levels finer whose centre lies in each cell."""
    reach = math.ceil(7.0 ** (step / 2) / 1.5) + 1
    centre = geo.cell_centre(F.col(cell))
    level = geo.cell_level(F.col(cell))
    fine = cells.withColumn("_start", geo.cell(centre["lat"], centre["lon"], level + step))
    fine = fine.withColumn("fijn", F.explode(geo.disk(F.col("_start"), reach))).drop("_start")
    return fine.where(geo.parent(F.col("fijn"), level) == F.col(cell))


def land_share(cells: DataFrame, cell: str, edges: DataFrame, step: int = 3) -> DataFrame:
    """The share of each cell that lies inside the rings: its finer cells, tested by centre."""
    fine = finer_cells(cells.select(cell).distinct(), cell, step).withColumn(
        "_c", geo.cell_centre(F.col("fijn"))).withColumns(
            {"x": F.col("_c.lon"), "y": F.col("_c.lat")}).drop("_c")
    tested = inside(fine, edges, "fijn")
    return tested.groupBy(cell).agg(F.avg(F.col("binnen").cast("double")).alias("aandeel"))


def noisy_cell(lat: Column, lon: Column, level: int, sigma_km: float, seed: int,
               record: Column) -> Column:
    """The cell of a point after Gaussian noise of ``sigma_km`` per axis."""
    if not sigma_km:
        return geo.cell(lat, lon, level)
    dy = gaussian(seed, "y", record) * sigma_km / 111.0
    dx = gaussian(seed, "x", record) * sigma_km / (F.cos(F.radians(lat)) * 111.0)
    return geo.cell(lat + dy, lon + dx, level)


def cell_distance(a: Column, b: Column) -> Column:
    """Steps between two cells of one level."""
    _, qa, ra = geo.parts(a)
    _, qb, rb = geo.parts(b)
    dq, dr = qa - qb, ra - rb
    return F.greatest(F.abs(dq), F.abs(dr), F.abs(dq + dr))


def noise_weights(fine: DataFrame, level: int, sigma_km: float, *, draws: int = DRAWS,
                  seed: int = 0) -> DataFrame:
    """``(fijn, cel, w)``: the chance that noise carries a place at the centre of a finer cell
    into each cell of ``level``. All places use the same draws."""
    d = fine.select("fijn").distinct().withColumn("_c", geo.cell_centre(F.col("fijn"))).select(
        "fijn", F.col("_c.lat").alias("_la"), F.col("_c.lon").alias("_lo"),
        F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_i"))
    to = noisy_cell(F.col("_la"), F.col("_lo"), level, sigma_km, seed, F.col("_i"))
    return d.groupBy("fijn", to.alias("cel")).agg(
        (F.count(F.lit(1)) / F.lit(float(draws))).alias("w"))


def cell_statistics(pairs: DataFrame, level: int, sigma_km: float, *, draws: int = DRAWS,
                    seed: int = 0) -> DataFrame:
    """Per cell of ``level``, for an attacker who knows the noise: rows in the cell, with its
    ring, the effective number of candidates (2 to the entropy of where a row really is), and
    the smallest set of finer cells that holds 95% of the probability.

    ``pairs``: ``(cel, fijn, n)``, rows per cell and finer cell. All cells in one job."""
    own = pairs.groupBy("cel").agg(F.sum("n").alias("woningen"))
    ring = (own.select(F.explode(geo.disk(F.col("cel"), 1)).alias("cel"),
                       F.col("woningen").alias("_n")).groupBy("cel")
            .agg(F.sum("_n").alias("met_buren")))
    base = own.join(ring, "cel").withColumn("gebied_km2", F.lit(geo.area_km2(level)))
    if sigma_km <= 0:
        return base.withColumn("k_eff", F.col("woningen").cast("double"))
    spacing = math.sqrt(3) * geo.edge_km(level)
    reach = 1 + math.ceil(2.5 * sigma_km / spacing)
    chance = noise_weights(pairs, level, sigma_km, draws=draws, seed=seed).withColumnRenamed(
        "cel", "doel")
    near = (pairs.join(chance, "fijn").where(cell_distance(F.col("cel"), F.col("doel")) <= reach)
            .groupBy("doel", "fijn").agg(F.sum("n").alias("n"), F.max("w").alias("w")))
    nw = F.col("n") * F.col("w")
    total = near.groupBy("doel").agg(F.sum(nw).alias("_t"),
                                     F.sum(nw * F.log2("w")).alias("_e"))
    k_eff = total.select(F.col("doel").alias("cel"), F.pow(
        F.lit(2.0), F.log2("_t") - F.col("_e") / F.col("_t")).alias("k_eff"))
    # the finer cells within reach of a cell: bounded by the noise, not by the data
    order = Window.partitionBy("doel").orderBy(F.desc("massa"), "fijn").rowsBetween(
        Window.unboundedPreceding, -1)
    mass = near.join(total, "doel").withColumn("massa", nw / F.col("_t"))
    heat = mass.withColumn("_before", F.coalesce(F.sum("massa").over(order), F.lit(0.0))).where(
        F.col("_before") < HEAT_SHARE)
    heat = heat.groupBy(F.col("doel").alias("cel")).agg(
        F.sum("n").alias("heat_woningen"), F.count(F.lit(1)).alias("heat_cellen"))
    return base.join(k_eff, "cel", "left").join(heat, "cel", "left")


def cell_verdict(k_eff: Column, k: int) -> Column:
    """Effective candidates against the norm: twice, once, or too few."""
    return F.when(k_eff >= 2 * k, "ruim genoeg").when(k_eff >= k, "genoeg").otherwise("te weinig")


def zones(df: DataFrame, column: str) -> DataFrame:
    """The weather zones of a dataset: records per cell and its level."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("n")).withColumn("niveau", geo.cell_level(F.col(column)))


WEATHER_CELL, WEATHER_STATION, HEAT_ISLAND = "weerzone_h3", "weer_knmi_station", "uhi"


def add_weather(df: DataFrame, *, method: str | None, lat: str, lon: str, record: str = "record_id",
                level: int = 5, sigma: float = 10.0, seed: int = 0, count_noise: bool = True,
                station: str | None = None) -> tuple[DataFrame, float | None]:
    """A weather location as a published column: the noisy cell, or the station of the linked
    row. Older weather columns go. Returns the dataset and the tolerance in km that goes with it."""
    out = df.drop(WEATHER_CELL, WEATHER_STATION, HEAT_ISLAND)
    if method == "h3":
        c = noisy_cell(F.col(lat), F.col(lon), level, float(sigma), seed, F.col(record))
        return out.withColumn(WEATHER_CELL, c), float(sigma) if count_noise else 0.0
    if method == "knmi":
        if station is None:
            raise ValueError("name the column that holds the station of the linked row")
        return out.withColumn(WEATHER_STATION, F.col(station)), 0.0
    return out, None


def add_heat_island(df: DataFrame, table: DataFrame, step: float, postcode: str) -> DataFrame:
    """The heat island of each record's postcode, in classes of ``step`` degrees."""
    from ..catalogue import CATALOGUE, Qid
    from .enrich import with_mean_per_postcode
    from .generalize import Bin

    out = with_mean_per_postcode(df, table, postcode=postcode, column=HEAT_ISLAND)
    out = out.withColumn(HEAT_ISLAND, F.col(HEAT_ISLAND).cast("string"))
    return Bin(HEAT_ISLAND, float(step)).apply(out, [Qid(HEAT_ISLAND, CATALOGUE["uhi"])])[0]
