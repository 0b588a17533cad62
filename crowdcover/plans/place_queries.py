"""Places: stations, cells, polygons, noise, walls and blocks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..catalogue import CATALOGUE, CATEGORICAL, Knowledge, Qid, custom
from ..functions import geo
from ..functions.numbers import uniform
from ..operators import enrich, facade, spatial
from ..operators.assess import assess
from ..operators.population import Population
from .views import table

# Positions follow from a hash of the key, in a box around the middle of the country.


def _points(df, key, name):
    return df.select(F.col(key).alias(name), (uniform("lat", F.col(key)) * 2 + 51).alias("lat__degN"),
                     (uniform("lon", F.col(key)) * 3 + 4).alias("lon__degE"))


def customers(spark, d):
    return _points(table(spark, d, "customer"), "c_custkey", "id")


def stations(spark, d):
    s = _points(table(spark, d, "supplier"), "s_suppkey", "knmi_station")
    return s.withColumnsRenamed({"lat__degN": "lat", "lon__degE": "lon"})


def _u(tag, key):
    return f"(('0x' || substr(md5('{tag}|' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


PTS = f"""pts AS (SELECT c_custkey AS id, {_u('lat', 'c_custkey')} * 2 + 51 AS la,
  {_u('lon', 'c_custkey')} * 3 + 4 AS lo, c_mktsegment AS seg FROM customer),
 sts AS (SELECT s_suppkey::VARCHAR AS s, {_u('lat', 's_suppkey')} * 2 + 51 AS la, {_u('lon', 's_suppkey')} * 3 + 4 AS lo FROM supplier)"""


def nearest_station(spark, d):
    return enrich.nearest(customers(spark, d), stations(spark, d)).select(
        "id", "knmi_station__cat", F.round("afstand__km", 6).alias("afstand__km"))


def nearest_by_cell(spark, d):
    return enrich.nearest(customers(spark, d), stations(spark, d)).select(
        "id", "knmi_station__cat", F.round("afstand__km", 6).alias("afstand__km"))


HAVERSINE = """2 * 6371.0088 * asin(sqrt(pow(sin(radians(s.la - p.la) / 2), 2) + cos(radians(p.la)) * cos(radians(s.la))
   * pow(sin(radians(s.lo - p.lo) / 2), 2)))"""
NEAREST = f"""WITH {PTS} SELECT id, arg_min(s, km) AS knmi_station__cat, round(min(km), 6) AS afstand__km
  FROM (SELECT id, s.s, {HAVERSINE} AS km FROM pts p, sts s) GROUP BY id"""

KX, KY = 111.32 * math.cos(math.radians(52.2)), 110.57


def cell_sql(la, lo, level):
    """The hexagon of a point, by cube rounding written out once more in SQL."""
    e = 9.85 * 7.0 ** ((5 - level) / 2)
    x, y = f"(({lo}) * {KX!r}::DOUBLE)", f"(({la}) * {KY!r}::DOUBLE)"
    q = f"(({x} * {math.sqrt(3.0) / 3.0!r}::DOUBLE - {y} / 3.0::DOUBLE) / {e!r}::DOUBLE)"
    r = f"(({y} * {2.0 / 3.0!r}::DOUBLE) / {e!r}::DOUBLE)"
    return (f"(SELECT '{level}:' || CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END || ':' || "
            f"CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END FROM (SELECT *, "
            f"abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds FROM (SELECT *, "
            f"floor(q + 0.5)::BIGINT AS rq, floor(r + 0.5)::BIGINT AS rr, floor(-q - r + 0.5)::BIGINT AS rs "
            f"FROM (SELECT {q} AS q, {r} AS r))))")


def hex_cells(spark, d):
    return geo.with_cells(customers(spark, d), (4, 5, 6, 7, 8), name=lambda n: f"r{n}").drop(
        "lat__degN", "lon__degE")


HEX = f"WITH {PTS} SELECT id, " + ", ".join(
    f"{cell_sql('la', 'lo', n)} AS r{n}" for n in (4, 5, 6, 7, 8)) + " FROM pts"


def cell_counts(spark, d):
    p = geo.with_cells(enrich.nearest(customers(spark, d), stations(spark, d)), (5,), name=lambda n: "cel")
    return spatial.main_station(p, "cel", "knmi_station__cat")


COUNTS = f"""WITH {PTS}, n AS (SELECT id, arg_min(s, km) AS s FROM (SELECT id, s.s, {HAVERSINE} AS km FROM pts p, sts s) GROUP BY id),
 c AS (SELECT {cell_sql('la', 'lo', 5)} AS cel, s, count(*) AS n FROM pts JOIN n USING (id) GROUP BY ALL)
SELECT cel, sum(n)::BIGINT AS n, (SELECT s FROM c b WHERE b.cel = a.cel ORDER BY b.n DESC, s LIMIT 1) AS knmi_station__cat
FROM c a GROUP BY cel"""


def largest_regions(spark, d):
    c = customers(spark, d).join(table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("regio")), "id")
    return spatial.largest_regions(c, "regio", "lat__degN", "lon__degE", 10).withColumns(
        {"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


LARGEST = f"""WITH {PTS} SELECT c_nationkey AS regio, round(avg(la), 6) AS lat, round(avg(lo), 6) AS lon, count(*) AS n
 FROM pts JOIN customer ON id = c_custkey GROUP BY 1 ORDER BY n DESC, regio LIMIT 10"""


def noisy_cells(spark, d):
    p = customers(spark, d)
    return p.select("id", spatial.noisy_cell(F.col("lat__degN"), F.col("lon__degE"), 5, 10.0, 4,
                                             F.col("id")).alias("cel"))


def _gauss(seed, axis, key):
    def u(tag):
        return f"(('0x' || substr(md5('{seed}|{axis}|' || {key} || '|{tag}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"

    return (f"(sqrt(-2.0::DOUBLE * ln(greatest({u('u')}, 1e-12))) * cos({2 * math.pi!r}::DOUBLE * {u('v')}))")


NOISY = f"""WITH {PTS}, n AS (SELECT id, la + {_gauss(4, 'y', 'id')} * 10.0 / 111.0 AS la2,
   lo + {_gauss(4, 'x', 'id')} * 10.0 / (cos(radians(la)) * 111.0) AS lo2 FROM pts)
SELECT id, {cell_sql('la2', 'lo2', 5)} AS cel FROM n"""


def cell_statistics(spark, d):
    p = geo.with_cells(customers(spark, d), (4, 6), name=lambda n: f"r{n}")
    pairs = spatial.counts_per(p, "r4", "r6").withColumnsRenamed({"r4": "cel", "r6": "fijn"})
    s = spatial.cell_statistics(pairs, 4, 6.0, draws=50)
    return s.select("cel", "woningen", "met_buren", F.round("k_eff", 6).alias("k_eff"),
                    spatial.cell_verdict(F.col("k_eff"), 11).alias("oordeel"))


_S6 = 9.85 * 7.0 ** -0.5
_REACH = 1 + math.ceil(2.5 * 6.0 / (math.sqrt(3) * 9.85 * 7.0 ** 0.5))


def _axial(c):
    return f"split_part({c}, ':', 2)::BIGINT", f"split_part({c}, ':', 3)::BIGINT"


def _steps(a, b):
    (qa, ra), (qb, rb) = _axial(a), _axial(b)
    return f"greatest(abs({qa} - {qb}), abs({ra} - {rb}), abs({qa} - {qb} + {ra} - {rb}))"


STATISTICS = f"""WITH {PTS}, pr AS (SELECT {cell_sql('la', 'lo', 4)} AS cel, {cell_sql('la', 'lo', 6)} AS fijn, count(*) AS n
   FROM pts GROUP BY ALL),
 own AS (SELECT cel, sum(n) AS n FROM pr GROUP BY cel),
 fc AS (SELECT DISTINCT fijn, {_S6!r}::DOUBLE * {_axial('fijn')[1]} * 1.5 / {KY!r} AS la,
   {_S6!r}::DOUBLE * ({_axial('fijn')[0]} * {math.sqrt(3.0)!r}::DOUBLE + {_axial('fijn')[1]} * {math.sqrt(3.0) / 2!r}::DOUBLE) / {KX!r} AS lo FROM pr),
 dr AS (SELECT fijn, la + {_gauss(0, 'y', 'range')} * 6.0 / 111.0 AS la, lo + {_gauss(0, 'x', 'range')} * 6.0
   / (cos(radians(la)) * 111.0) AS lo FROM fc, range(50)),
 w AS (SELECT fijn, {cell_sql('la', 'lo', 4)} AS doel, count(*) / 50.0::DOUBLE AS w FROM dr GROUP BY ALL),
 nr AS (SELECT doel, fijn, sum(n) AS n, max(w) AS w FROM pr JOIN w USING (fijn) WHERE {_steps('cel', 'doel')} <= {_REACH} GROUP BY ALL),
 t AS (SELECT doel, sum(n * w) AS t, sum(n * w * log2(w)) AS e FROM nr GROUP BY doel)
SELECT a.cel, a.n::BIGINT AS woningen, (SELECT sum(n) FROM own b WHERE {_steps('a.cel', 'b.cel')} <= 1)::BIGINT AS met_buren,
  round(pow(2.0, log2(t) - e / t), 6) AS k_eff, CASE WHEN pow(2.0, log2(t) - e / t) >= 22 THEN 'ruim genoeg'
    WHEN pow(2.0, log2(t) - e / t) >= 11 THEN 'genoeg' WHEN t IS NOT NULL THEN 'te weinig' ELSE 'te weinig' END AS oordeel
FROM own a LEFT JOIN t ON doel = a.cel"""


def _rings(spark, d):
    """A seven-cornered star per nation around a place of its own, some overlapping."""
    n = table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("seq"))
    k = F.col("n_nationkey")
    a = F.col("seq") * (2 * math.pi / 7)
    r = 0.25 + 0.1 * (F.col("seq") % 2)
    return n.select("n_nationkey", "seq", (4 + 3 * uniform("rx", k) + r * F.cos(a)).alias("x"),
                    (51 + 2 * uniform("ry", k) + r * F.sin(a)).alias("y"))


def inside_polygons(spark, d):
    e = spatial.ring_edges(_rings(spark, d), ["n_nationkey"])
    p = customers(spark, d).withColumnsRenamed({"lon__degE": "x", "lat__degN": "y"})
    return spatial.inside(p, e, "id").select("id", "binnen")


INSIDE = f"""WITH {PTS}, v AS (SELECT n_nationkey AS k, i, 4 + 3 * {_u('rx', 'n_nationkey')} + (0.25 + 0.1 * (i % 2)) * cos(i * {2 * math.pi / 7!r}::DOUBLE) AS x,
   51 + 2 * {_u('ry', 'n_nationkey')} + (0.25 + 0.1 * (i % 2)) * sin(i * {2 * math.pi / 7!r}::DOUBLE) AS y
   FROM nation, (SELECT range AS i FROM range(7))),
 e AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.k = b.k AND b.i = (a.i + 1) % 7)
SELECT id, count(x1) % 2 = 1 AS binnen FROM pts LEFT JOIN e ON (y1 > la) <> (y2 > la)
  AND lo < x1 + (la - y1) * (x2 - x1) / (y2 - y1) GROUP BY id"""


def land_share(spark, d):
    e = spatial.ring_edges(_rings(spark, d), ["n_nationkey"])
    cells = geo.with_cells(customers(spark, d), (4,), name=lambda n: "cel").select("cel").distinct()
    return spatial.land_share(cells, "cel", e, 3).withColumn("aandeel", F.round("aandeel", 6))


def heat_classes(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("record_id"),
                                           F.lower("c_mktsegment").alias("pc"))
    heat = table(spark, d, "customer").select(F.col("c_mktsegment").alias("postcode6"),
                                              (F.col("c_acctbal") / 3000).alias("uhi"))
    return spatial.add_heat_island(c, heat, 0.25, "pc").select("record_id", "uhi")


HEAT = """WITH u AS (SELECT c_mktsegment AS seg, floor(avg(c_acctbal / 3000) / 0.25) * 0.25 AS lo FROM customer GROUP BY 1)
SELECT c_custkey AS record_id, format('{:g}', lo) || '-' || format('{:g}', lo + 0.25) AS uhi FROM customer JOIN u ON seg = c_mktsegment"""


def rd_positions(spark, d):
    p = table(spark, d, "customer").select("c_custkey", (uniform("x", F.col("c_custkey")) * 200000 + 50000).alias("x"),
                                           (uniform("y", F.col("c_custkey")) * 250000 + 330000).alias("y"))
    la, lo = geo.rd_to_wgs84(F.col("x"), F.col("y"))
    return p.select("c_custkey", F.round(la, 7).alias("lat"), F.round(lo, 7).alias("lon"))


def _rd_sql():
    def total(terms):
        return " + ".join(f"({k!r} * pow(dx, {p}) * pow(dy, {q}))" for (p, q), k in terms.items())

    return f"""WITH p AS (SELECT c_custkey, ({_u('x', 'c_custkey')} * 200000 + 50000 - 155000.0) * 1e-5 AS dx,
  ({_u('y', 'c_custkey')} * 250000 + 330000 - 463000.0) * 1e-5 AS dy FROM customer)
SELECT c_custkey, round(52.15517440 + ({total(geo.RD_LAT)}) / 3600, 7) AS lat,
  round(5.38720621 + ({total(geo.RD_LON)}) / 3600, 7) AS lon FROM p"""


# --- walls: a street grid, ten customers to a row, gaps of 0, 0.3 and 1 m ----------------------------

def footprints(spark, d):
    """Rectangles 10 m deep on plots of 6 m; clockwise or not by turns, so both occur."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("pand"), F.floor(k / 10).alias("rij"), (k % 10).alias("kol"),
                                           F.get(F.lit([0.0, 0.3, 1.0]), (k % 3).cast("int")).alias("gat"))
    x1, y1 = F.col("kol") * 6.0, F.col("rij") * 20.0
    x2, y2 = x1 + 6.0 - F.col("gat"), y1 + 10.0
    corners = [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]
    turned = list(reversed(corners))

    def ring(pts):
        return F.array(*[F.struct(F.lit(i).alias("seq"), a.alias("x"), b.alias("y"))
                         for i, (a, b) in enumerate(pts)])

    v = F.when(F.col("pand") % 2 == 0, ring(corners)).otherwise(ring(turned))
    return c.select("pand", F.lit(0).alias("ring"), F.lit(False).alias("hole"), F.explode(v).alias("v")).select(
        "pand", "ring", "hole", "v.seq", "v.x", "v.y")


STREET = """street AS (SELECT c_custkey AS pand, c_custkey // 10 AS rij, c_custkey % 10 AS kol,
  [0.0, 0.3, 1.0][c_custkey % 3 + 1]::DOUBLE AS gat FROM customer),
 touch AS (SELECT a.pand AS a, b.pand AS b FROM street a JOIN street b ON a.rij = b.rij AND b.kol = a.kol + 1 AND a.gat <= 0.5)"""


def ring_edges(spark, d):
    e = facade.edges(footprints(spark, d))
    return e.groupBy("pand").agg(
        F.count(F.lit(1)).alias("zijden"), F.round(F.sum("lengte"), 6).alias("omtrek"),
        F.round(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2, 6).alias("oppervlak"))


RING_EDGES = f"""WITH {STREET} SELECT pand, 4::BIGINT AS zijden, round(2 * (6 - gat + 10), 6) AS omtrek,
  round((6 - gat) * 10, 6) AS oppervlak FROM street"""


def shared_walls(spark, d):
    e = facade.edges(footprints(spark, d))
    return facade.shared_walls(facade.shared_pairs(e)).where("lengte > 0").withColumn(
        "lengte", F.round("lengte", 6))


SHARED = f"""WITH {STREET} SELECT a AS pand, b AS buurpand, 10.0::DOUBLE AS lengte FROM touch
 UNION ALL SELECT b, a, 10.0 FROM touch"""


def exposed_walls(spark, d):
    e = facade.edges(footprints(spark, d))
    out = facade.exposed_per_sector(facade.exposed_edges(e, facade.shared_pairs(e)))
    return out.select("pand", *[F.round(c, 6).alias(c) for c in out.columns if c != "pand"])


def _exposed_sql():
    zero = [f"0.0::DOUBLE AS gevel_{s}__m" for s in ("no", "zo", "zw", "nw")]
    zero += [f"0.0::DOUBLE AS gevelzij_{s}__m" for s in ("n", "no", "zo", "z", "zw", "nw")]
    return f"""WITH {STREET}, w AS (SELECT pand, gat, EXISTS (SELECT 1 FROM touch WHERE a = pand) AS east,
  EXISTS (SELECT 1 FROM touch WHERE b = pand) AS west FROM street)
SELECT pand, round(6 - gat, 6) AS gevel_n__m, round(6 - gat, 6) AS gevel_z__m,
  CASE WHEN east THEN 0.0 ELSE 10.0 END::DOUBLE AS gevel_o__m, CASE WHEN west THEN 0.0 ELSE 10.0 END::DOUBLE AS gevel_w__m,
  CASE WHEN east THEN 0.0 ELSE 10.0 END::DOUBLE AS gevelzij_o__m, CASE WHEN west THEN 0.0 ELSE 10.0 END::DOUBLE AS gevelzij_w__m,
  {', '.join(zero)} FROM w"""


def neighbours(spark, d):
    """Neighbours and blocks along the streets, and the type they give."""
    v = footprints(spark, d)
    e = facade.edges(v)
    links = facade.links(facade.shared_pairs(e))
    n = facade.neighbours(v.select("pand").distinct(), links)
    return n.withColumn("type", enrich.type_from_neighbours(F.col("buren__0"), F.col("blok_panden__0")))


NEIGHBOURS = f"""WITH {STREET}, s AS (SELECT pand, rij, kol, CASE WHEN lag(gat) OVER (PARTITION BY rij ORDER BY kol) <= 0.5 THEN 0 ELSE 1 END AS begin,
   EXISTS (SELECT 1 FROM touch WHERE a = pand)::INT + EXISTS (SELECT 1 FROM touch WHERE b = pand)::INT AS buren FROM street),
 g AS (SELECT *, sum(begin) OVER (PARTITION BY rij ORDER BY kol) AS nr FROM s),
 b AS (SELECT rij, nr, count(*) AS n, min(pand) AS blok FROM g GROUP BY ALL)
SELECT pand, buren::BIGINT AS buren__0, n AS blok_panden__0, blok, CASE WHEN buren = 0 THEN 'vrijstaand' WHEN n = 2 THEN 'twee_onder_een_kap'
  WHEN buren = 1 THEN 'hoekwoning' ELSE 'tussenwoning' END AS type FROM g JOIN b USING (rij, nr)"""


def trading_blocks(spark, d):
    """Connected components of a graph with very busy nodes: customers and the days they ordered."""
    o = table(spark, d, "orders")
    e = o.select(F.col("o_custkey").alias("a"), (-F.datediff("o_orderdate", F.lit("1990-01-01"))
                 .cast("bigint") - F.when(F.col("o_custkey") % 2 == 0, 0).otherwise(100000)).alias("b"))
    out = facade.blocks(e.select("a"), e)
    return out.groupBy("blok").agg(F.count(F.lit(1)).alias("leden"))


def _land_sql():
    r3, r32 = f"{math.sqrt(3.0)!r}::DOUBLE", f"{math.sqrt(3.0) / 2!r}::DOUBLE"
    e4, e6 = f"{9.85 * 7.0 ** 0.5!r}::DOUBLE", f"{9.85 / 7.0!r}::DOUBLE"
    q, r = _axial("cel")
    fq, fr = _axial("f")
    rings = INSIDE[INSIDE.index("v AS"):INSIDE.index("SELECT id, count(x1)")]
    return f"""WITH {PTS}, {rings}, cl AS (SELECT DISTINCT {cell_sql('la', 'lo', 4)} AS cel FROM pts),
 ct AS (SELECT cel, {e4} * {r} * 1.5 / {KY!r} AS la, {e4} * ({q} * {r3} + {r} * {r32}) / {KX!r} AS lo FROM cl),
 st AS (SELECT cel, {cell_sql('la', 'lo', 7)} AS f FROM ct),
 cd AS (SELECT cel, {fq} + a.range - 16 AS q, {fr} + b.range - 16 AS r FROM st, range(33) a, range(33) b),
 ps AS (SELECT cel, q, r, {e6} * r * 1.5 / {KY!r} AS la, {e6} * (q * {r3} + r * {r32}) / {KX!r} AS lo FROM cd),
 fi AS (SELECT * FROM ps WHERE {cell_sql('la', 'lo', 4)} = cel),
 te AS (SELECT cel, q, r, count(x1) % 2 AS b FROM fi LEFT JOIN e ON (y1 > la) <> (y2 > la)
   AND lo < x1 + (la - y1) * (x2 - x1) / (y2 - y1) GROUP BY cel, q, r)
SELECT cel, round(avg(b), 6) AS aandeel FROM te GROUP BY cel"""


TRADING = """WITH RECURSIVE o AS (SELECT DISTINCT o_custkey AS a, -datediff('day', TIMESTAMP '1990-01-01', o_orderdate)
   - CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE 100000 END AS b FROM orders),
 e AS (SELECT a, b FROM o UNION ALL SELECT b, a FROM o),
 cc(node, lab) USING KEY (node) AS (SELECT a AS node, a AS lab FROM (SELECT DISTINCT a FROM e)
   UNION SELECT e.b, min(c.lab) FROM cc c JOIN e ON e.a = c.node JOIN recurring.cc r ON r.node = e.b
   WHERE c.lab < r.lab GROUP BY e.b)
SELECT lab AS blok, count(*) AS leden FROM cc WHERE node >= 0 GROUP BY lab"""


def assess_cells(spark, d):
    """Customers published by cell and segment, when the true point may lie 5 km away: counted in
    the cell and its ring, at the level the cells turn out to have."""
    p = geo.with_cells(customers(spark, d), (4, 5)).join(table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg")), "id")
    ds = p.select(F.col("id").alias("record_id"), F.col("h3_r5__str").alias("zone"), "seg")
    q = [Qid("zone", CATALOGUE["h3_cel"], tolerance=5.0),
         Qid("seg", custom("seg", CATEGORICAL, Knowledge.REGISTER, population_column="seg"))]
    return assess(ds, q, Population(p)).select("record_id", "f_dataset", "k_populatie", "status")


ASSESS_CELLS = f"""WITH {PTS}, c AS (SELECT id, seg, {cell_sql('la', 'lo', 5)} AS cel FROM pts),
 g AS (SELECT cel, seg, count(*) AS n FROM c GROUP BY ALL),
 k AS (SELECT a.cel, a.seg, a.n AS f, sum(b.n) AS k FROM g a JOIN g b ON a.seg = b.seg AND {_steps('a.cel', 'b.cel')} <= 1 GROUP BY ALL)
SELECT id AS record_id, f AS f_dataset, k::BIGINT AS k_populatie, CASE WHEN k < 11 THEN 'risico' ELSE 'ok' END AS status
FROM c JOIN k USING (cel, seg)"""


def weather_zones(spark, d):
    ds, _ = spatial.add_weather(customers(spark, d), method="h3", lat="lat__degN", lon="lon__degE",
                                record="id", level=5, sigma=10.0, seed=4)
    return spatial.zones(ds, spatial.WEATHER_CELL)


ZONES = f"""WITH {PTS}, n AS (SELECT id, la + {_gauss(4, 'y', 'id')} * 10.0 / 111.0 AS la2,
   lo + {_gauss(4, 'x', 'id')} * 10.0 / (cos(radians(la)) * 111.0) AS lo2 FROM pts)
SELECT {cell_sql('la2', 'lo2', 5)} AS weerzone_h3, count(*) AS n, 5 AS niveau FROM n GROUP BY 1"""


QUERIES = {
    "nearest_station": (nearest_station, NEAREST),
    "nearest_by_cell": (nearest_by_cell, NEAREST),
    "rd_positions": (rd_positions, _rd_sql()),
    "hex_cells": (hex_cells, HEX),
    "cell_counts": (cell_counts, COUNTS),
    "largest_regions": (largest_regions, LARGEST),
    "noisy_cells": (noisy_cells, NOISY),
    "cell_statistics": (cell_statistics, STATISTICS),
    "inside_polygons": (inside_polygons, INSIDE),
    "land_share": (land_share, _land_sql()),
    "heat_classes": (heat_classes, HEAT),
    "ring_edges": (ring_edges, RING_EDGES),
    "shared_walls": (shared_walls, SHARED),
    "exposed_walls": (exposed_walls, _exposed_sql()),
    "neighbours_and_blocks": (neighbours, NEIGHBOURS),
    "connected_blocks": (trading_blocks, TRADING),
    "assess_cells": (assess_cells, ASSESS_CELLS),
    "weather_zones": (weather_zones, ZONES),
}
