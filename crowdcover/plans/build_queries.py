"""Linking, building a population from registers, and representativeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as clean
from ..operators import enrich, represent
from ..operators.link import link
from ..operators.population import Population
from ..operators.represent import Feature
from ..sources import sinks
from .views import POP, pop_rows, population, table

# --- customers as an address register -------------------------------------------------------------

ADDRESS = """reg AS (SELECT c_custkey, lpad(c_custkey::VARCHAR, 16, '0') AS vbo,
  (c_custkey % 300 + 1000) || 'AB' AS pc, (c_custkey % 7 + 1) AS nr,
  CASE WHEN c_custkey % 2 = 0 THEN 'a' END AS letter, n_name AS nat, c_acctbal AS bal
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def register(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"),
                                        F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    return c.select(
        clean.padded_id(k).alias("vbo_id__str"),
        F.concat((k % 300 + 1000).cast("string"), F.lit("AB")).alias("postcode6__str"),
        (k % 7 + 1).cast("string").alias("huisnummer__str"),
        F.when(k % 2 == 0, "a").alias("huisletter__str"),
        F.lit(None).cast("string").alias("toevoeging__str"), F.col("n_name").alias("gemeente__cat"),
        F.col("c_acctbal").alias("uhi__degC"))


def link_by_id(spark, d):
    """Orders to the customer register by id; ids in the dataset are not padded."""
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("record_id"),
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey").cast("string")).alias("bag"))
    out = link(o, Population(register(spark, d)), vbo_id="bag", columns=["gemeente__cat"])
    return out.select("record_id", "register_gemeente__cat", "register_gekoppeld__bool")


LINK_ID = f"""WITH {ADDRESS} SELECT o_orderkey AS record_id, nat AS register_gemeente__cat,
  nat IS NOT NULL AS register_gekoppeld__bool FROM orders LEFT JOIN reg
  ON o_custkey = c_custkey AND o_orderkey % 10 <> 0"""


def link_by_address(spark, d):
    """Suppliers to customers by address; several fits means no link."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(
        k.alias("record_id"), F.concat((k % 350 + 1000).cast("string"), F.lit(" ab")).alias("pc"),
        F.concat((k % 7 + 1).cast("string"), F.lit(".0")).alias("nr"),
        F.when(k % 3 == 0, F.lit("A ")).alias("letter"))
    out = link(s, Population(register(spark, d)), postcode="pc", huisnummer="nr", huisletter="letter",
               columns=["vbo_id__str", "gemeente__cat"])
    return out.select("record_id", "register_vbo_id__str", "register_gemeente__cat",
                      "register_gekoppeld__bool")


LINK_ADDRESS = f"""WITH {ADDRESS}, j AS (SELECT s_suppkey AS record_id, vbo, nat,
  count(vbo) OVER (PARTITION BY s_suppkey) AS n FROM supplier LEFT JOIN reg
  ON pc = (s_suppkey % 350 + 1000) || 'AB' AND nr = s_suppkey % 7 + 1
 AND upper(coalesce(letter, '')) = CASE WHEN s_suppkey % 3 = 0 THEN 'A' ELSE '' END)
SELECT DISTINCT record_id, CASE WHEN n = 1 THEN vbo END AS register_vbo_id__str,
  CASE WHEN n = 1 THEN nat END AS register_gemeente__cat, n = 1 AS register_gekoppeld__bool FROM j"""


# --- registers -----------------------------------------------------------------------------------------

def latest_label(spark, d):
    """Line items as repeated registrations of an order: the latest one counts."""
    li = table(spark, d, "lineitem").withColumn("tie", F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return enrich.latest(li, ["l_orderkey"], "l_shipdate", "tie").select(
        "l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_returnflag")


LATEST = """SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey, l_returnflag FROM lineitem
 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC NULLS LAST,
   l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1"""


def star_population(spark, d):
    """Orders as dwellings: dwellings per building (customer), municipality, latest label, the
    type from the shape with the registered one winning, plausible years, and a mean per
    postcode."""
    p = pop_rows(spark, d)
    rows = p.select(F.col("id").cast("string").alias("vbo_id__str"), F.col("cust").alias("pand_id__str"),
                    "nat", enrich.within(F.col("yr"), 1996, 2000).alias("bouwjaar__yr"),
                    F.col("seg").alias("postcode6__str"))
    li = table(spark, d, "lineitem").withColumn("tie", F.struct("l_linenumber", "l_partkey",
                                                                "l_suppkey", "l_extendedprice"))
    labels = enrich.latest(li, ["l_orderkey"], "l_shipdate", "tie").select(
        F.col("l_orderkey").cast("string").alias("vbo_id__str"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("type_reg"),
        F.col("l_quantity").alias("energie_index__0"))
    regions = table(spark, d, "nation").select(F.col("n_name").alias("nat"),
                                               F.col("n_regionkey").alias("provincie__cat"))
    rows = enrich.star_join(rows, {"pand_id__str": enrich.per_building(rows), "nat": regions})
    shape = enrich.type_from_shape(F.col("pand_woningen__0"), F.col("provincie__cat"),
                                   F.col("provincie__cat") + 1)
    rows = rows.withColumn("woningtype__cat", shape)
    rows = enrich.with_registered(rows, labels, "vbo_id__str", "type_reg", "woningtype__cat",
                                  "woningtype_bron__cat")
    heat = table(spark, d, "customer").select(F.lower("c_mktsegment").alias("pc6"),
                                              F.col("c_acctbal").alias("uhi"))
    out = enrich.with_mean_per_postcode(rows, heat)
    return out.select("vbo_id__str", "bouwjaar__yr", "pand_woningen__0", "eengezins__bool",
                      "provincie__cat", "woningtype__cat", "woningtype_bron__cat",
                      "energie_index__0", F.round("uhi__degC", 4).alias("uhi__degC"))


STAR = f"""WITH {POP}, b AS (SELECT cust, count(*) AS n FROM pop GROUP BY cust),
 l AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC NULLS LAST,
   l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1),
 u AS (SELECT c_mktsegment AS seg, avg(c_acctbal) AS uhi FROM customer GROUP BY 1),
 s AS (SELECT id, CASE WHEN yr BETWEEN 1996 AND 2000 THEN yr END AS yr, n, n_regionkey AS rk, seg,
   CASE WHEN n > 1 THEN 'appartement' WHEN n_regionkey = 0 THEN 'vrijstaand' WHEN n_regionkey = 1 THEN 'twee_onder_een_kap'
     ELSE 'tussenwoning' END AS shape FROM pop JOIN b USING (cust) JOIN nation ON nat = n_name)
SELECT id::VARCHAR AS vbo_id__str, yr AS bouwjaar__yr, n AS pand_woningen__0, n = 1 AS eengezins__bool,
  rk AS provincie__cat, coalesce(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END, shape) AS woningtype__cat,
  CASE WHEN l_returnflag <> 'N' THEN 'ep-online' ELSE 'vorm' END AS woningtype_bron__cat,
  l_quantity AS energie_index__0, round(uhi, 4) AS uhi__degC
FROM s LEFT JOIN l ON l_orderkey = id LEFT JOIN u USING (seg)"""


def overlay(spark, d):
    """A supplement per order: where its flag is set its values win, unknown ones included."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("regels"), F.max("l_quantity").alias("q"))
    s = li.select(F.col("l_orderkey").alias("o_orderkey"),
                  F.when(F.col("q") > 20, F.lit("groot")).alias("o_orderpriority"),
                  (F.col("regels") > 3).alias("aangevuld__bool"), "regels")
    return enrich.overlay(o, s, "o_orderkey")


OVERLAY = """WITH li AS (SELECT l_orderkey, count(*) AS regels, max(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN coalesce(regels > 3, FALSE) THEN CASE WHEN q > 20 THEN 'groot' END ELSE o_orderpriority END
  AS o_orderpriority, o_totalprice, regels FROM orders LEFT JOIN li ON l_orderkey = o_orderkey"""


def equal_columns(spark, d):
    o = table(spark, d, "orders").withColumns({
        "kopie": F.col("o_totalprice"), "bijna": F.when(F.col("o_orderkey") > 5, F.col("o_orderstatus")),
        "leeg": F.lit(None).cast("string"), "ook_leeg": F.lit(None).cast("string")})
    return enrich.equal_columns(o, {"kopie": "o_totalprice", "bijna": "o_orderstatus", "leeg": "ook_leeg"})


EQUAL = """SELECT 'kopie' AS kolom, 'o_totalprice' AS gelijk_aan, 0::BIGINT AS verschillen
 UNION ALL SELECT 'bijna', 'o_orderstatus', count(*) FROM orders WHERE o_orderkey <= 5
 UNION ALL SELECT 'leeg', 'ook_leeg', 0"""


def population_extract(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("vbo_id__str"), (F.col("c_custkey") / 7.0).alias("lat__degN"),
        F.col("c_acctbal").alias("oppervlakte__m2"), F.col("c_name").alias("naam"))
    return sinks.extract(c, rounded=["oppervlakte__m2"])


EXTRACT = """SELECT c_custkey AS vbo_id__str, round(c_custkey / 7.0::DOUBLE, 5) AS lat__degN,
  CASE WHEN c_acctbal = 0 THEN 0.0 ELSE round_even(c_acctbal * pow(10.0, 2 - floor(log10(abs(c_acctbal)))), 0)
    / pow(10.0, 2 - floor(log10(abs(c_acctbal)))) END AS oppervlakte__m2 FROM customer"""


def building_shape(spark, d):
    """Parts as buildings, line items as their roof parts."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    b = p.select(F.concat(F.lit("NL.IMBAG.Pand."), F.lpad(k.cast("string"), 16, "0")).alias("identificatie"),
                 F.get(F.lit(["slanted", "horizontal", "multiple horizontal", "no points"]),
                       (k % 4).cast("int")).alias("b3_dak_type"),
                 (F.col("p_size") / 10.0).alias("b3_bouwlagen"), (F.col("p_retailprice") / 100).alias("b3_h_maaiveld"),
                 F.when(k % 5 != 0, (k % 3).cast("double")).alias("b3_opp_scheidingsmuur"),
                 *[(F.col("p_retailprice") / n).alias(f"b3_{c}") for n, c in (
                     (3.0, "opp_grond"), (7.0, "opp_dak_plat"), (9.0, "opp_dak_schuin"), (11.0, "opp_buitenmuur"))])
    roofs = table(spark, d, "lineitem").select(
        F.concat(F.lit("NL.IMBAG.Pand."), F.lpad(F.col("l_partkey").cast("string"), 16, "0")).alias("identificatie"),
        F.col("l_quantity").alias("b3_h_70p"))
    out = enrich.building_shape(b, roofs)
    return out.select("pand_id__str", "daktype__cat", "bouwlagen__0", "hoogte__m", "aaneengebouwd__bool")


SHAPE = """WITH r AS (SELECT l_partkey, max(l_quantity) AS h FROM lineitem GROUP BY 1)
SELECT lpad(p_partkey::VARCHAR, 16, '0') AS pand_id__str, CASE p_partkey % 4 WHEN 0 THEN 'schuin' WHEN 1 THEN 'plat'
   WHEN 2 THEN 'plat_meerdere' END AS daktype__cat, round_even(p_size / 10.0::DOUBLE, 0)::BIGINT AS bouwlagen__0,
 CASE WHEN round(h - p_retailprice / 100, 1) BETWEEN 0 AND 400 THEN round(h - p_retailprice / 100, 1) END AS hoogte__m,
 CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 3 > 0 END AS aaneengebouwd__bool
FROM part LEFT JOIN r ON l_partkey = p_partkey"""


def facade_areas(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    rows = p.select("p_partkey", F.when(k % 4 == 0, 0.0).when(k % 4 == 1, F.col("p_size").cast("double"))
                    .alias("hoogte__m"), F.when(k % 3 == 0, k % 5).alias("bouwlagen__0"),
                    (k % 6 == 0).cast("int").alias("x"), (k % 2 + 1).alias("pand_woningen__0"),
                    (F.col("p_size") / 4.0).alias("gevel_n__m"))
    return enrich.facade_areas(rows.drop("x"), ["gevel_n__m"]).select(
        "p_partkey", F.round("gevel_n__m2", 6).alias("gevel_n__m2"))


FACADE = """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN round(p_size / 4.0::DOUBLE * coalesce(
  CASE WHEN p_partkey % 4 = 1 AND p_size <> 0 THEN p_size::DOUBLE END,
  CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 5) * 2.8::DOUBLE END, 5.6), 6) END AS gevel_n__m2 FROM part"""


def dwelling_register(spark, d):
    """Orders in the role of a register of dwellings: those that exist, implausible numbers as unknown."""
    i = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "Verblijfsobject in gebruik").when(
        F.col("o_orderstatus") == "P", "Verbouwing verblijfsobject").otherwise("Verblijfsobject ingetrokken")
    reg = table(spark, d, "orders").select(
        i.cast("string").alias("identificatie"), F.col("o_custkey").cast("string").alias("pand_identificatie"),
        F.concat((i % 500 + 1000).cast("string"), F.lit(" ab")).alias("postcode"), (i % 20 + 1).alias("huisnummer"),
        F.when(i % 3 == 0, "a").alias("huisletter"), F.lit(None).cast("string").alias("toevoeging"),
        F.concat(F.lit("G"), (i % 7).cast("string")).alias("bronhouder_identificatie"),
        F.when(i % 9 == 0, 9999).otherwise(i % 120 + 1900).cast("int").alias("bouwjaar"),
        (i % 300).cast("int").alias("oppervlakte"), status.alias("status"), F.col("o_totalprice").alias("rd_x"),
        (F.col("o_totalprice") * 2).alias("rd_y"))
    return enrich.dwellings(reg)


DWELLING_REGISTER = """SELECT o_orderkey::VARCHAR AS vbo_id__str, o_custkey::VARCHAR AS pand_id__str,
  (o_orderkey % 500 + 1000) || 'AB' AS postcode6__str, (o_orderkey % 500 + 1000)::VARCHAR AS postcode4__str,
  (o_orderkey % 20 + 1)::VARCHAR AS huisnummer__str, CASE WHEN o_orderkey % 3 = 0 THEN 'a' END AS huisletter__str,
  NULL::VARCHAR AS toevoeging__str, 'G' || o_orderkey % 7 AS gemeente_code__str,
  CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 120 + 1900)::INTEGER END AS bouwjaar__yr,
  CASE WHEN o_orderkey % 300 > 0 THEN (o_orderkey % 300)::INTEGER END AS oppervlakte__m2,
  CASE o_orderstatus WHEN 'F' THEN 'Verblijfsobject in gebruik' ELSE 'Verbouwing verblijfsobject' END AS status__cat,
  o_totalprice AS rd_x__m, o_totalprice * 2 AS rd_y__m FROM orders WHERE o_orderstatus IN ('F', 'P')"""


# --- representativeness -----------------------------------------------------------------------------

DRAWS = 20


def shift(spark, d):
    """What leaving out the pending orders does to price and priority."""
    p = pop_rows(spark, d).select(F.col("id").alias("record_id"), "price", "lab", "seg",
                                  (F.col("st") != "P").alias("blijft"))
    return represent.shift(p, "blijft", ["price", "lab", "seg"], draws=DRAWS, seed=3)


SHIFT = f"""WITH {POP}, m AS (SELECT count(*) AS n, count(*) FILTER (st = 'P') AS m FROM pop),
 dr AS (SELECT range AS draw FROM range({DRAWS})),
 om AS (SELECT -1 AS draw, id FROM pop WHERE st = 'P' UNION ALL SELECT draw, id FROM (SELECT draw, id,
   row_number() OVER (PARTITION BY draw ORDER BY ('0x' || substr(md5('3|' || draw || '|' || id), 1, 13))::BIGINT) AS rn
   FROM pop, dr), m WHERE rn <= m),
 al AS (SELECT -1 AS draw UNION ALL SELECT draw FROM dr),
 w AS (SELECT avg(price) AS mu, stddev_pop(price) AS sd, sum(price) AS s FROM pop),
 g AS (SELECT draw, sum(price) AS gs, count(*) AS gn FROM om JOIN pop USING (id) GROUP BY draw),
 num AS (SELECT 'price' AS kolom, draw, 'SMD' AS maat, ((s - gs) / (n - gn) - mu) / sd AS size FROM g, w, m),
 cat AS (SELECT id, 'lab' AS kolom, coalesce(lab, '(leeg)') AS x FROM pop UNION ALL SELECT id, 'seg', seg FROM pop),
 cw AS (SELECT kolom, x, count(*) AS c FROM cat GROUP BY ALL),
 cg AS (SELECT draw, kolom, x, count(*) AS c FROM om JOIN cat USING (id) GROUP BY ALL),
 tv AS (SELECT cw.kolom, al.draw, 'TVD' AS maat, 0.5 * sum(abs(cw.c / n - (cw.c - coalesce(cg.c, 0)) / (n - m))) AS size
   FROM cw CROSS JOIN al CROSS JOIN m LEFT JOIN cg ON cg.kolom = cw.kolom AND cg.x = cw.x AND cg.draw = al.draw GROUP BY 1, 2),
 a AS (SELECT * FROM num UNION ALL SELECT * FROM tv),
 o AS (SELECT kolom, maat, size AS v FROM a WHERE draw = -1)
SELECT o.kolom, o.maat, round(v, 3) AS waarde,
  CASE WHEN abs(v) < CASE maat WHEN 'SMD' THEN 0.1 ELSE 0.05 END THEN 'verwaarloosbaar'
       WHEN abs(v) < CASE maat WHEN 'SMD' THEN 0.2 ELSE 0.1 END THEN 'klein' ELSE 'merkbaar' END AS oordeel,
  round((SELECT avg(CASE WHEN abs(size) >= abs(v) - 1e-12 THEN 1.0 ELSE 0.0 END) FROM a
         WHERE a.kolom = o.kolom AND draw >= 0), 3)::DOUBLE AS toeval FROM o"""


def largest_change(spark, d):
    p = pop_rows(spark, d).withColumn("blijft", F.col("st") != "P")
    return represent.largest_change(p, "blijft", ["lab", "seg"]).withColumns(
        {c: F.round(c, 9) for c in ("aandeel", "aandeel_gehouden")})


LARGEST = f"""WITH {POP}, cat AS (SELECT st, 'lab' AS kolom, coalesce(lab, '(leeg)') AS categorie FROM pop
   UNION ALL SELECT st, 'seg', seg FROM pop),
 s AS (SELECT kolom, categorie, count(*) / (SELECT count(*) FROM pop) AS a,
   count(*) FILTER (st <> 'P') / (SELECT count(*) FROM pop WHERE st <> 'P') AS b FROM cat GROUP BY ALL)
SELECT kolom, categorie, round(a, 9) AS aandeel, round(b, 9) AS aandeel_gehouden FROM s
QUALIFY row_number() OVER (PARTITION BY kolom ORDER BY round(abs(b - a), 12) DESC, categorie) = 1"""


def _published(spark, d):
    return pop_rows(spark, d).where("st = 'F'").select(F.col("id").alias("record_id"), "price", "yr",
                                                      "lab", "seg")


CATS = [Feature("lab"), Feature("seg")]


def category_comparison(spark, d):
    return represent.compare_categories(_published(spark, d), population(spark, d), CATS, draws=DRAWS,
                                        seed=7)


_CAT = f"""{POP}, cells AS (SELECT 'lab' AS kenmerk, coalesce(lab, '(leeg)') AS klasse, st FROM pop
   UNION ALL SELECT 'seg', seg, st FROM pop),
 c AS (SELECT kenmerk, klasse, count(*) AS pop, count(*) FILTER (st = 'F') AS ds FROM cells GROUP BY ALL),
 t AS (SELECT kenmerk, sum(pop) AS tp, sum(ds) AS n FROM c GROUP BY kenmerk),
 o AS (SELECT kenmerk, max(n) AS n, 0.5 * sum(abs(ds / n - pop / tp)) AS v FROM c JOIN t USING (kenmerk) GROUP BY 1),
 laid AS (SELECT kenmerk, klasse, pop, tp, sum(pop) OVER (PARTITION BY kenmerk ORDER BY
   ('0x' || substr(md5(klasse), 1, 13))::BIGINT ROWS UNBOUNDED PRECEDING) AS cum FROM c JOIN t USING (kenmerk)),
 dr AS (SELECT range AS draw FROM range({DRAWS})),
 pick AS (SELECT kenmerk, draw, id, ('0x' || substr(md5('SEED|' || kenmerk || '|' || draw || '|' || id), 1, 8))::BIGINT
   / 4294967296.0::DOUBLE AS u FROM (SELECT DISTINCT kenmerk FROM c), dr, (SELECT id FROM pop WHERE st = 'F')),
 hit AS (SELECT p.kenmerk, draw, klasse, count(*) AS k FROM pick p JOIN laid l ON l.kenmerk = p.kenmerk
   AND u >= (cum - pop) / tp AND u < cum / tp GROUP BY ALL),
 sim AS (SELECT c.kenmerk, dr.draw, 0.5 * sum(abs(coalesce(k, 0) / n - pop / tp)) AS tvd FROM c JOIN t USING (kenmerk)
   CROSS JOIN dr LEFT JOIN hit ON hit.kenmerk = c.kenmerk AND hit.klasse = c.klasse AND hit.draw = dr.draw GROUP BY 1, 2)"""
CATEGORY = "WITH " + _CAT.replace("SEED", "7") + """
SELECT kenmerk, n::BIGINT AS n, 'TVD' AS maat, round(v, 3) AS waarde, CASE WHEN v < 0.05 THEN 'verwaarloosbaar'
  WHEN v < 0.1 THEN 'klein' ELSE 'merkbaar' END AS oordeel,
  round((SELECT avg(CASE WHEN tvd >= v - 1e-12 THEN 1.0 ELSE 0.0 END) FROM sim WHERE sim.kenmerk = o.kenmerk), 3)::DOUBLE
    AS toeval FROM o"""


def chance_percentile(spark, d):
    return represent.chance_percentile(_published(spark, d), population(spark, d), CATS, draws=DRAWS,
                                       seed=9).withColumn("tvd_toeval", F.round("tvd_toeval", 9))


CHANCE95 = "WITH " + _CAT.replace("SEED", "9") + """
SELECT kenmerk, round(quantile_cont(tvd, 0.95), 9) AS tvd_toeval FROM sim GROUP BY kenmerk"""


def number_comparison(spark, d):
    return represent.compare_numbers(_published(spark, d), population(spark, d),
                                     [Feature("price"), Feature("yr")], draws=DRAWS, seed=11,
                                     n_quantiles=200)


def _number_sql():
    def one(c):
        return f"""SELECT * FROM (WITH {POP}, w AS (SELECT avg({c}) AS mu, stddev_pop({c}) AS sd FROM pop),
 gr AS (SELECT range AS i, (range + 0.5) / 200 AS p FROM range(200)),
 f AS (SELECT id, {c}::DOUBLE AS x FROM pop WHERE st = 'F'),
 q AS (SELECT i, (SELECT quantile_cont({c}::DOUBLE, [{', '.join(repr((i + 0.5) / 200) for i in range(200))}]) FROM pop)[i + 1] AS qp,
   (SELECT quantile_cont(x, [{', '.join(repr((i + 0.5) / 200) for i in range(200))}]) FROM f)[i + 1] AS qd FROM gr),
 o AS (SELECT count(*) AS n, (avg(x) - max(mu)) / max(sd) AS smd FROM f, w),
 pk AS (SELECT draw, ('0x' || substr(md5('11|{c}|' || draw || '|' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 200 - 0.5 AS pos
   FROM f, (SELECT range AS draw FROM range({DRAWS}))),
 m AS (SELECT draw, avg(CASE WHEN pos <= 0 THEN (SELECT qp FROM q WHERE i = 0) WHEN pos >= 199 THEN (SELECT qp FROM q WHERE i = 199)
   ELSE a.qp + (b.qp - a.qp) * (pos - floor(pos)) END) AS mean FROM pk LEFT JOIN q a ON a.i = floor(pos)
   LEFT JOIN q b ON b.i = floor(pos) + 1 GROUP BY draw)
SELECT '{c}' AS kenmerk, n, 'SMD' AS maat, round(smd, 3) AS waarde,
  round((SELECT sum(abs(ca / (SELECT count(*) FROM pop) - cb / (SELECT count(*) FROM f)) * (nx - x)) FROM (
    SELECT x, sum(a) OVER (ORDER BY x) AS ca, sum(b) OVER (ORDER BY x) AS cb, lead(x) OVER (ORDER BY x) AS nx FROM (
      SELECT {c}::DOUBLE AS x, count(*) AS a, count(*) FILTER (st = 'F') AS b FROM pop GROUP BY 1))) / sd, 3) AS wasserstein,
  CASE WHEN abs(smd) < 0.1 THEN 'verwaarloosbaar' WHEN abs(smd) < 0.2 THEN 'klein' ELSE 'merkbaar' END AS oordeel,
  round((SELECT avg(CASE WHEN abs((mean - mu) / sd) >= abs(smd) - 1e-12 THEN 1.0 ELSE 0.0 END) FROM m), 3)::DOUBLE AS toeval
 FROM o, w)"""

    return one("price") + " UNION ALL " + one("yr")


def class_shares(spark, d):
    feats = [Feature("lab"), Feature("seg"), Feature("yr", None, (1996.0, 1998.0, 2000.0))]
    c = represent.category_counts(_published(spark, d), population(spark, d), feats)
    return represent.class_table(c, 300)


SHARES = f"""WITH {POP}, cells AS (SELECT 'lab' AS kenmerk, coalesce(lab, '(leeg)') AS klasse, st FROM pop
   UNION ALL SELECT 'seg', seg, st FROM pop UNION ALL SELECT 'yr', CASE WHEN yr < 1996 THEN '< 1996'
     WHEN yr < 1998 THEN '1996 tot 1998' WHEN yr < 2000 THEN '1998 tot 2000' ELSE '≥ 2000' END, st FROM pop),
 c AS (SELECT kenmerk, klasse, count(*) AS p, count(*) FILTER (st = 'F') AS k FROM cells GROUP BY ALL),
 s AS (SELECT *, p / sum(p) OVER (PARTITION BY kenmerk) AS ps, k / sum(k) OVER (PARTITION BY kenmerk) AS ks,
   sum(k) OVER (PARTITION BY kenmerk) AS tk FROM c)
SELECT kenmerk, klasse, round(ps, 4) AS populatie, CASE WHEN k >= 300 THEN round(ks, 4) END AS dataset,
  CASE WHEN ks > ps + 1e-9 THEN '+' WHEN ks < ps - 1e-9 THEN '−' ELSE '=' END AS richting,
  k = tk AND round(ps, 4) < 1 - 1e-9 AS alle_records FROM s"""


def population_quantiles(spark, d):
    moments, q = represent.population_numbers(population(spark, d), ["price", "yr"], 100)
    return q.join(moments, "kenmerk").select(
        "kenmerk", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), "n",
        F.round("mu", 6).alias("mu"), F.round("sd", 6).alias("sd"))


def _quantile_sql():
    def one(c):
        ps = ", ".join(repr((i + 0.5) / 100) for i in range(100))
        return f"""SELECT '{c}' AS kenmerk, round((i + 0.5) / 100, 6)::DOUBLE AS p, round(qs[i + 1], 6) AS q, n,
  round(mu, 6) AS mu, round(sd, 6) AS sd FROM (SELECT quantile_cont({c}::DOUBLE, [{ps}]) AS qs, count({c}) AS n,
  avg({c}) AS mu, stddev_pop({c}) AS sd FROM pop), (SELECT range AS i FROM range(100))"""

    return f"WITH {POP} " + one("price") + " UNION ALL " + one("yr")


def linked_comparison(spark, d):
    """Suppliers linked to the customer register, compared with all customers on balance."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(k.alias("record_id"), k.cast("string").alias("bag"))
    pop = Population(register(spark, d))
    linked = link(s, pop, vbo_id="bag", columns=["vbo_id__str", "gemeente__cat", "uhi__degC"])
    feats = [Feature("uhi__degC", None, (0.0, 5000.0)), Feature("gemeente__cat")]
    t, _ = represent.compare_linked(linked, pop, feats, draws=0)
    return t.select("kenmerk", "n", "maat", "waarde", "wasserstein", "oordeel")


_P1000 = ", ".join(repr((i + 0.5) / 1000) for i in range(1000))
LINKED = f"""WITH {ADDRESS}, l AS (SELECT s_suppkey, bal, nat FROM supplier JOIN reg ON s_suppkey = c_custkey),
 w AS (SELECT avg(bal) AS mu, stddev_pop(bal) AS sd, quantile_cont(bal, [{_P1000}]) AS qp FROM reg),
 f AS (SELECT count(bal) AS n, avg(bal) AS m, quantile_cont(bal, [{_P1000}]) AS qd FROM l),
 x AS (SELECT n, (m - mu) / sd AS v, (SELECT avg(abs(a - b)) FROM (SELECT unnest(qp) AS a, unnest(qd) AS b)) / sd AS ws FROM w, f),
 c AS (SELECT nat, count(*) AS p, (SELECT count(*) FROM l WHERE l.nat = reg.nat) AS k FROM reg GROUP BY nat),
 t AS (SELECT sum(k)::BIGINT AS n, 0.5 * sum(abs(k / (SELECT count(*) FROM l) - p / (SELECT count(*) FROM reg))) AS v FROM c)
SELECT 'uhi__degC' AS kenmerk, n, 'SMD' AS maat, round(v, 3) AS waarde, round(ws, 3) AS wasserstein,
  CASE WHEN abs(v) < 0.1 THEN 'verwaarloosbaar' WHEN abs(v) < 0.2 THEN 'klein' ELSE 'merkbaar' END AS oordeel FROM x
UNION ALL SELECT 'gemeente__cat', n, 'TVD', round(v, 3), NULL,
  CASE WHEN v < 0.05 THEN 'verwaarloosbaar' WHEN v < 0.1 THEN 'klein' ELSE 'merkbaar' END FROM t"""


QUERIES = {
    "link_by_id": (link_by_id, LINK_ID),
    "link_by_address": (link_by_address, LINK_ADDRESS),
    "latest_label": (latest_label, LATEST),
    "star_population": (star_population, STAR),
    "overlay_supplement": (overlay, OVERLAY),
    "equal_columns": (equal_columns, EQUAL),
    "population_extract": (population_extract, EXTRACT),
    "building_shape": (building_shape, SHAPE),
    "facade_areas": (facade_areas, FACADE),
    "dwelling_register": (dwelling_register, DWELLING_REGISTER),
    "shift_of_columns": (shift, SHIFT),
    "largest_change": (largest_change, LARGEST),
    "category_comparison": (category_comparison, CATEGORY),
    "chance_percentile": (chance_percentile, CHANCE95),
    "number_comparison": (number_comparison, _number_sql()),
    "class_shares": (class_shares, SHARES),
    "population_quantiles": (population_quantiles, _quantile_sql()),
    "linked_comparison": (linked_comparison, LINKED),
}
