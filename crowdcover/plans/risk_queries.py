"""Risk, its explanation, and what is reported about it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import Knowledge
from ..functions import cleaning as clean
from ..functions import constraints as con
from ..operators import explain, report, rounding
from ..operators.assess import Threshold, assess, constraints, summary
from ..operators.population import Scope
from ..sources.datasets import parse_scope, scope_items
from .views import CONS, POP, dataset, pop_rows, population, qids, risk, table

COLS = ["record_id", "klasse", "f_dataset", "k_populatie", "k", "k_geschat", "delta", "risico",
        "status", "redenen"]
SELECT = """SELECT id AS record_id, klasse, f AS f_dataset, big_f AS k_populatie,
  round(k, 6)::DOUBLE AS k, {est} AS k_geschat, round(delta, 9) AS delta,
  round(risico, 9)::DOUBLE AS risico, status, redenen FROM res"""


def _shown(df):
    return df.select(*COLS).withColumns({"k": F.round("k", 6), "delta": F.round("delta", 9),
                                         "risico": F.round("risico", 9)})


def assess_register(spark, d):
    return _shown(assess(dataset(spark, d), qids(), population(spark, d)))


def assess_blocks(spark, d):
    return _shown(assess(dataset(spark, d), qids(), population(spark, d), strategy="blocks"))


def assess_unknown_matches(spark, d):
    return _shown(assess(dataset(spark, d), qids(), population(spark, d), unknown_matches=True))


def assess_scoped(spark, d):
    pop = population(spark, d)
    scope = parse_scope(spark, scope_items(["yr=1996-2000", "seg=BUILDING,FURNITURE,MACHINERY",
                                            "lab!=5-LOW"]), pop.columns)
    return _shown(assess(dataset(spark, d), qids(), pop.within(scope)))


def assess_insider(spark, d):
    return _shown(assess(dataset(spark, d), [*qids(), *qids("maand")], population(spark, d),
                         scenario=Knowledge.INSIDER))


SHARE = "(count(*) OVER (PARTITION BY mo) / count(*) OVER ())"


def assess_summary(spark, d):
    return summary(assess(dataset(spark, d), qids(), population(spark, d))).withColumns(
        {"delta_max": F.round("delta_max", 9)})


def numeric_only(spark, d):
    a = assess(dataset(spark, d), qids("jaar", "prijs"), population(spark, d))
    return a.select("record_id", "k_populatie")


NUMERIC_ONLY = f"""WITH {POP}, {CONS},
 classes AS (SELECT DISTINCT ylo, yhi, plo, phi FROM cons),
 counts AS (SELECT ylo, yhi, plo, phi, (SELECT count(*) FROM pop p
   WHERE (c.ylo IS NULL OR p.yr >= c.ylo) AND (c.yhi IS NULL OR p.yr <= c.yhi)
     AND (c.plo IS NULL OR p.price >= c.plo) AND (c.phi IS NULL OR p.price <= c.phi)) AS n
   FROM classes c)
SELECT id AS record_id, n AS k_populatie FROM cons s JOIN counts c
  ON s.ylo IS NOT DISTINCT FROM c.ylo AND s.yhi IS NOT DISTINCT FROM c.yhi
 AND s.plo IS NOT DISTINCT FROM c.plo AND s.phi IS NOT DISTINCT FROM c.phi"""


# --- constraints -----------------------------------------------------------------------------------

def constraint_table(spark, d):
    f = constraints(dataset(spark, d), qids(), "record_id")
    return f.select("record_id", *[con.render(F.col(f"c{i}")).alias(n) for i, n in enumerate(
        ("jaar", "prijs", "label", "segment", "land"))])


def _text(lo, hi):
    lo_, hi_ = f"CAST({lo} AS BIGINT)", f"CAST({hi} AS BIGINT)"
    return (f"CASE WHEN {lo} IS NULL AND {hi} IS NULL THEN '' WHEN {lo} = {hi} THEN {lo_}::VARCHAR "
            f"WHEN {lo} IS NULL THEN '<=' || {hi_} WHEN {hi} IS NULL THEN '>=' || {lo_} "
            f"ELSE {lo_} || '-' || {hi_} END")


CONSTRAINT_TABLE = f"""WITH {POP}, {CONS} SELECT id AS record_id, {_text('ylo', 'yhi')} AS jaar,
  {_text('plo', 'phi')} AS prijs, coalesce(array_to_string(labs, '|'), '') AS label, seg AS segment,
  coalesce(nat, '') AS land FROM cons"""


def constraint_hull(spark, d):
    f = constraints(dataset(spark, d), qids("jaar", "prijs", "label", "segment"), "record_id")
    f = f.withColumn("seg", F.upper("segment")).where(F.col("jaar") != "onbekend")
    return f.groupBy("seg", "maand").agg(
        con.render(con.hull(F.col("c0"))).alias("jaar"), con.render(con.hull(F.col("c2"))).alias("label"))


CONSTRAINT_HULL = f"""WITH {POP}, {CONS}, g AS (SELECT seg, mo,
  CASE WHEN count(ylo) = count(*) THEN min(ylo) END AS lo,
  CASE WHEN count(yhi) = count(*) THEN max(yhi) END AS hi,
  CASE WHEN count(labs) = count(*) THEN
    array_to_string(list_sort(list_distinct(flatten(list(labs)))), '|') ELSE '' END AS label
  FROM cons WHERE ylo IS NOT NULL OR yhi IS NOT NULL GROUP BY seg, mo)
SELECT seg, mo::VARCHAR AS maand, {_text('lo', 'hi')} AS jaar, label FROM g"""


def constraint_reading(spark, d):
    """Years read as rounded to 5, prices widened by a tolerance."""
    q = [qids("jaar")[0].with_(reading=con.Reading(5.0)), qids("prijs")[0].with_(tolerance=250.5)]
    f = constraints(dataset(spark, d), q, "record_id")
    return f.select("record_id", F.col("c0.lo").alias("jaar_lo"), F.col("c0.hi").alias("jaar_hi"),
                    F.col("c1.lo").alias("prijs_lo"), F.col("c1.hi").alias("prijs_hi"))


CONSTRAINT_READING = f"""WITH {POP}, {CONS} SELECT id AS record_id,
  ceil(ylo - 2.5)::DOUBLE AS jaar_lo, (ceil(yhi + 2.5) - 1)::DOUBLE AS jaar_hi,
  (plo - 250.5)::DOUBLE AS prijs_lo, (phi + 250.5)::DOUBLE AS prijs_hi FROM cons"""


def narrowest_class(spark, d):
    """Two classes of the same price: of 50,000 wide from 0, and of 80,000 wide from 20,000."""
    p = pop_rows(spark, d)
    a = F.concat((F.floor(F.col("price") / 50000) * 50000).cast("string"), F.lit("-"),
                 (F.floor(F.col("price") / 50000) * 50000 + 49999).cast("string"))
    lo = F.floor((F.col("price") - 20000) / 80000) * 80000 + 20000
    b = F.when(F.col("id") % 7 == 0, F.concat(F.lit(">"), (lo + 90000).cast("string"))).otherwise(
        F.concat(lo.cast("string"), F.lit("-"), (lo + 79999).cast("string")))
    p = p.select("id", con.parse_numeric(a).alias("a"), con.parse_numeric(b).alias("b"))
    return p.select("id", con.render(con.narrowest(F.col("a"), F.col("b"))).alias("klasse"),
                    con.contradicts(F.col("a"), F.col("b")).alias("tegenstrijdig"))


NARROWEST = f"""WITH {POP}, t AS (SELECT id, CAST(floor(price / 50000) * 50000 AS BIGINT) AS alo,
  CAST(floor((price - 20000) / 80000) * 80000 + 20000 AS BIGINT) AS b0 FROM pop),
 u AS (SELECT id, alo, alo + 49999 AS ahi, CASE WHEN id % 7 = 0 THEN b0 + 90001 ELSE b0 END AS blo,
  CASE WHEN id % 7 <> 0 THEN b0 + 79999 END AS bhi FROM t),
 v AS (SELECT id, alo, ahi, greatest(alo, blo) AS lo, least(ahi, coalesce(bhi, ahi)) AS hi FROM u)
SELECT id, CASE WHEN lo > hi THEN alo || '-' || ahi WHEN lo = hi THEN lo::VARCHAR
  ELSE lo || '-' || hi END AS klasse, lo > hi AS tegenstrijdig FROM v"""


# --- cleaning ----------------------------------------------------------------------------------------

def clean_stations(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey") + 200
    raw = F.when(k % 3 == 0, F.concat(F.lit("06"), k.cast("string"))).when(
        k % 3 == 1, F.concat(k.cast("string"), F.lit(".0"))).otherwise(
            F.concat(F.lit(" "), k.cast("string"), F.lit(" ")))
    return s.select("s_suppkey", clean.station(raw).alias("station"))


CLEAN_STATIONS = """SELECT s_suppkey, CASE WHEN (s_suppkey + 200) % 3 = 0 AND s_suppkey + 200 >= 1000
  THEN (s_suppkey + 200)::VARCHAR WHEN s_suppkey + 200 = 210 THEN '215'
  ELSE (s_suppkey + 200)::VARCHAR END AS station FROM supplier"""


def clean_types(spark, d):
    """Dwelling types, roofs, labels and yes/no in several wordings, one per document."""
    w = ["Twee-onder-een-kap", "2 onder 1 kap", "Semi-detached", "vrijstaande woning", "detached",
         "Galerijflat", "hoekwoning", "tussenwoning", "rijtjeshuis", "appartement", "kasteel"]
    r = ["Schuin dak", "plat", "meerdere platte daken", "zadeldak", "koepel"]
    e = ["label A++", "c", "Label g", "H", " b "]
    y = ["Ja", "NO", "waar", "0", "misschien"]

    def nth(words):
        return F.get(F.lit(words), (F.col("doc_id") % len(words)).cast("int"))

    return table(spark, d, "documents").select(
        "doc_id", clean.dwelling_type(nth(w)).alias("woningtype"), clean.roof(nth(r)).alias("dak"),
        clean.label(nth(e)).alias("label"), clean.boolean(nth(y)).alias("vlag"))


CLEAN_TYPES = """SELECT doc_id,
  CASE WHEN doc_id % 11 <= 2 THEN 'twee_onder_een_kap' WHEN doc_id % 11 <= 4 THEN 'vrijstaand'
       WHEN doc_id % 11 = 5 THEN 'appartement' WHEN doc_id % 11 = 6 THEN 'hoekwoning'
       WHEN doc_id % 11 <= 8 THEN 'tussenwoning' WHEN doc_id % 11 = 9 THEN 'appartement' END
    AS woningtype,
  CASE doc_id % 5 WHEN 0 THEN 'schuin' WHEN 1 THEN 'plat' WHEN 2 THEN 'plat_meerdere'
    WHEN 3 THEN 'schuin' END AS dak,
  CASE doc_id % 5 WHEN 0 THEN 'A++' WHEN 1 THEN 'C' WHEN 2 THEN 'G' WHEN 4 THEN 'B' END AS label,
  CASE doc_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'true' WHEN 3 THEN 'false' END
    AS vlag FROM documents"""


def address_keys(spark, d):
    c = table(spark, d, "customer")
    pc = F.concat((F.col("c_custkey") % 9000 + 1000).cast("string"), F.lit(" ab"))
    return c.select("c_custkey", clean.postcode_key(pc).alias("pc"),
                    clean.postcode4(pc).alias("pc4"),
                    clean.number_key(F.substring("c_name", 10, 9)).alias("nr"),
                    clean.part_key(F.when(F.col("c_custkey") % 3 == 0, F.lit(" a "))).alias("letter"),
                    clean.padded_id(F.col("c_custkey")).alias("id"))


ADDRESS_KEYS = """SELECT c_custkey, (c_custkey % 9000 + 1000) || 'AB' AS pc,
  (c_custkey % 9000 + 1000)::VARCHAR AS pc4, substr(c_name, 10, 9)::BIGINT AS nr,
  CASE WHEN c_custkey % 3 = 0 THEN 'A' ELSE '' END AS letter, lpad(c_custkey::VARCHAR, 16, '0') AS id
  FROM customer"""


def panel_totals(spark, d):
    """Per user the total over all weeks, only when every week has events; whether any purchase
    was made, unknown without events of that kind; and the number of weeks."""
    e = table(spark, d, "events")
    week = e.groupBy("user_id", F.weekofyear("ts").alias("wk")).agg(
        F.sum("value").alias("v"),
        F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("p"))
    return week.groupBy("user_id").agg(
        F.round(F.when(F.count("v") == 5, F.sum("v")), 6).alias("totaal"),
        F.max(F.col("p") > 0).alias("aankoop"), F.count(F.lit(1)).alias("weken"))


PANEL = """WITH week AS (SELECT user_id, weekofyear(ts) AS wk, sum(value) AS v,
   sum(CASE WHEN event_type = 'purchase' THEN value END) AS p FROM events GROUP BY ALL)
 SELECT user_id, round(CASE WHEN count(v) = 5 THEN sum(v) END, 6) AS totaal,
   bool_or(p > 0) AS aankoop, count(*) AS weken FROM week GROUP BY user_id"""


def class_texts(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey", clean.class_text(p, 25000).alias("klasse"),
        clean.class_text(p, 50000, below=100000, above=400000).alias("met_staarten"),
        clean.margin_text(F.year("o_orderdate"), 2).alias("jaar"))


CLASS_TEXTS = """WITH t AS (SELECT o_orderkey, year(o_orderdate) AS y,
   CAST(floor(o_totalprice / 25000) * 25000 AS BIGINT) AS a,
   CAST(floor(o_totalprice / 50000) * 50000 AS BIGINT) AS b FROM orders)
 SELECT o_orderkey, '[' || a || ' - ' || (a + 24999) || ']' AS klasse,
   CASE WHEN b < 100000 THEN '<100000' WHEN b >= 400000 THEN '400000=>'
        ELSE '[' || b || ' - ' || (b + 49999) || ']' END AS met_staarten,
   (y - 2) || '-' || (y + 2) AS jaar FROM t"""


def value_sets(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type").distinct()
    return e.groupBy("user_id").agg(
        F.array_join(F.array_sort(F.collect_list("event_type")), "|").alias("soorten"))


VALUE_SETS = """SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), '|') AS soorten
  FROM events GROUP BY user_id"""


# --- reports -------------------------------------------------------------------------------------------

def candidate_lists(spark, d):
    pop = population(spark, d)
    a = assess(dataset(spark, d), qids(), pop)
    return report.candidates(a, qids(), pop, shown=["id"], max_per_record=20).select(
        "record", "status", "k_populatie", "kandidaat_nr", "id", "nat")


CANDIDATES = risk() + """, cl AS (SELECT c.*, n FROM classes c JOIN counts USING (klasse)),
 list AS (SELECT c.klasse, p.id, p.nat,
   row_number() OVER (PARTITION BY c.klasse ORDER BY p.id) AS nr
   FROM cl c JOIN pop p ON """ + """(c.ylo IS NULL OR p.yr >= c.ylo) AND (c.yhi IS NULL OR p.yr <= c.yhi)
   AND (c.plo IS NULL OR p.price >= c.plo) AND (c.phi IS NULL OR p.price <= c.phi)
   AND (c.labs IS NULL OR list_contains(c.labs, p.lab)) AND p.seg = c.seg
   AND (c.nat IS NULL OR p.nat = c.nat) WHERE c.n <= 20)
SELECT r.id AS record, status, big_f AS k_populatie, nr AS kandidaat_nr, l.id, l.nat
FROM res r LEFT JOIN list l USING (klasse) WHERE status = 'risico'"""


def k_histogram(spark, d):
    return report.k_histogram(assess(dataset(spark, d), qids(), population(spark, d)), 11)


K_HISTOGRAM = risk() + """, e(klasse_nr, k_van, k_tot) AS (VALUES (0, 0.0::DOUBLE, 10.0::DOUBLE),
  (1, 11.0, 30.0), (2, 31.0, 100.0), (3, 101.0, 300.0), (4, 301.0, 1000.0),
  (5, 1001.0, 'infinity'::DOUBLE))
SELECT klasse_nr, k_van, k_tot, (SELECT count(*) FROM res WHERE k >= k_van AND k < k_tot + 1
  OR k = k_tot) AS records
FROM e"""


def failure_reasons(spark, d):
    return report.failure_reasons(assess(dataset(spark, d), qids(), population(spark, d)))


FAILURES = risk() + """ SELECT reden, count(*) AS records FROM (SELECT regexp_replace(
   unnest(string_split(redenen, '; ')), '=[0-9.e+-]+', '=…') AS reden FROM res WHERE status <> 'ok')
 GROUP BY reden ORDER BY records DESC, reden LIMIT 5"""


def publishable_records(spark, d):
    a = assess(dataset(spark, d), qids(), population(spark, d))
    return report.publishable(a, drop=["maand"])


PUBLISHABLE = risk() + """ SELECT id AS record_id,
  CASE id % 6 WHEN 0 THEN yr::VARCHAR WHEN 1 THEN (yr - 1) || '-' || (yr + 1) WHEN 2 THEN '<' || (yr + 1)
    WHEN 3 THEN '>=' || yr WHEN 4 THEN yr || ' t/m ' || (yr + 2) ELSE 'onbekend' END AS jaar,
  CASE id % 4 WHEN 0 THEN (floor(price / 50000)::BIGINT * 50000) || '-' || (floor(price / 50000)::BIGINT * 50000 + 50000)
    WHEN 1 THEN '<=' || (floor(price / 50000)::BIGINT * 50000 + 50000)
    WHEN 3 THEN '[' || (floor(price / 100000)::BIGINT * 100000) || ' - ' || (floor(price / 100000)::BIGINT * 100000 + 100000) || ']' END AS prijs,
  CASE WHEN lab IS NULL OR id % 3 = 2 THEN NULL WHEN id % 3 = 0 THEN lab ELSE lab || '|1-URGENT' END AS label,
  CASE WHEN id % 2 = 0 THEN pop.seg ELSE lower(pop.seg) END AS segment,
  CASE WHEN id % 5 < 4 THEN pop.nat END AS land
FROM res JOIN pop USING (id) WHERE status = 'ok'"""


def scenario_comparison(spark, d):
    """The same dataset for an attacker who knows less, and one who knows the month as well."""
    ds, pop = dataset(spark, d), population(spark, d)
    a = report.compare_scenarios(ds, {
        "alles": (qids(), Knowledge.REGISTER),
        "zonder_prijs": (qids("jaar", "label", "segment", "land"), Knowledge.REGISTER),
        "insider": ([*qids(), *qids("maand")], Knowledge.INSIDER)}, pop)
    return report.scenario_rows(a, "scenario").withColumn("k_mediaan", F.round("k_mediaan", 6))


def _scenario_sql():
    per = """SELECT '{name}' AS scenario, count(*) AS records,
  count(*) FILTER (status <> 'geen_match' AND k < 11) AS k_0_11,
  count(*) FILTER (status <> 'geen_match' AND k >= 11 AND k < 100) AS k_11_100,
  count(*) FILTER (status <> 'geen_match' AND k >= 100 AND k < 1000) AS k_100_1000,
  count(*) FILTER (status <> 'geen_match' AND k >= 1000) AS k_1000_plus,
  count(*) FILTER (status = 'geen_match') AS geen_match,
  count(*) FILTER (status <> 'geen_match' AND delta > 0.09) AS delta_boven_norm,
  count(*) FILTER (status = 'ok') AS publiceerbaar,
  round(quantile_cont(k, 0.5) FILTER (status <> 'geen_match'), 6)::DOUBLE AS k_mediaan FROM {t}"""
    no_price = CONS.replace("CASE id % 4 WHEN 0 THEN floor(price / 50000.0) * 50000\n",
                            "CASE id % 4 WHEN 9 THEN 0.0\n").replace(
        "WHEN 3 THEN floor(price / 100000.0) * 100000 END AS plo", "END AS plo").replace(
        "CASE id % 4 WHEN 0 THEN (floor(price / 50000.0) + 1) * 50000\n", "CASE id % 4 WHEN 9 THEN 0.0\n"
    ).replace("WHEN 1 THEN (floor(price / 50000.0) + 1) * 50000\n", "").replace(
        "WHEN 3 THEN (floor(price / 100000.0) + 1) * 100000 END AS phi", "END AS phi")
    parts = []
    for name, kw in (("alles", {}), ("zonder_prijs", {"cons": no_price}),
                     ("insider", {"share": SHARE})):
        parts.append("SELECT * FROM (" + risk(**kw) + " " + per.format(name=name, t="res") + ")")
    return " UNION ALL ".join(parts)


def candidate_areas(spark, d):
    """Blocks: the orders of a customer in a year; in which nations could the block lie?"""
    p = pop_rows(spark, d)
    block = p.groupBy("cust", "yr", "seg").agg(F.count(F.lit(1)).alias("grootte")).select(
        F.concat_ws(":", "cust", "yr").alias("record_id"), F.col("yr").cast("string").alias("jaar"),
        F.col("seg").alias("segment"), "grootte")
    return report.candidate_areas(block, qids("jaar", "segment"), population(spark, d), "nat",
                                  group=["record_id"], size="grootte")


CANDIDATE_AREAS = f"""WITH {POP}, b AS (SELECT cust || ':' || yr AS record_id, yr, seg, count(*) AS grootte
   FROM pop GROUP BY cust, yr, seg),
 n AS (SELECT yr, seg, nat, count(*) AS n FROM pop GROUP BY ALL)
SELECT record_id, grootte, count(nat) AS zones, count(*) FILTER (n >= grootte) AS zones_groot_genoeg,
  count(*) FILTER (n >= grootte / 2) AS zones_halve_grootte, coalesce(sum(n), 0)::BIGINT AS rijen
FROM b LEFT JOIN n USING (yr, seg) GROUP BY record_id, grootte"""


def zone_risk(spark, d):
    """Expected risk of every record when only the kind of zone (a nation) is published."""
    ds = dataset(spark, d).drop("land")
    counts = report.zone_counts(ds, qids("jaar", "prijs", "label", "segment"),
                                population(spark, d), "nat")
    return report.chance_too_small(counts, 11, record="record_id").withColumn(
        "kans", F.round("kans", 9))


ZONE_RISK = risk(cons=CONS.replace("CASE WHEN id % 5 < 4 THEN nat END AS nat", "NULL AS nat")) + """,
 z AS (SELECT c.klasse, p.nat, count(*) AS n FROM classes c JOIN pop p ON
   (c.ylo IS NULL OR p.yr >= c.ylo) AND (c.yhi IS NULL OR p.yr <= c.yhi)
   AND (c.plo IS NULL OR p.price >= c.plo) AND (c.phi IS NULL OR p.price <= c.phi)
   AND (c.labs IS NULL OR list_contains(c.labs, p.lab)) AND p.seg = c.seg GROUP BY ALL),
 q AS (SELECT klasse, sum(CASE WHEN n < 11 THEN n ELSE 0 END) / sum(n) AS kans FROM z GROUP BY klasse)
SELECT r.id AS record_id, round(kans, 9) AS kans FROM rec r LEFT JOIN q USING (klasse)"""


# --- explanation ---------------------------------------------------------------------------------------

def information_bits(spark, d):
    b = explain.information_bits(dataset(spark, d), [*qids(), *qids("maand")], population(spark, d),
                                 Knowledge.INSIDER)
    return b.withColumns({"bits_mediaan": F.round("bits_mediaan", 9), "bits_max": F.round("bits_max", 9)})


def _bits_sql():
    def one(name, cols, cond, known):
        on = " AND ".join(f"s.{c} IS NOT DISTINCT FROM c.{c}" for c in cols)
        return f"""SELECT '{name}' AS kenmerk, log2((SELECT count(*) FROM pop)::DOUBLE / greatest(n, 1)) AS bits
  FROM cons s JOIN (SELECT c.*, (SELECT count(*) FROM pop p WHERE {cond}) AS n
    FROM (SELECT DISTINCT {', '.join(cols)} FROM cons WHERE {known}) c) c ON {on}"""

    parts = [
        one("jaar", ["ylo", "yhi"], "(c.ylo IS NULL OR p.yr >= c.ylo) AND (c.yhi IS NULL OR p.yr <= c.yhi)",
            "ylo IS NOT NULL OR yhi IS NOT NULL"),
        one("prijs", ["plo", "phi"],
            "(c.plo IS NULL OR p.price >= c.plo) AND (c.phi IS NULL OR p.price <= c.phi)",
            "plo IS NOT NULL OR phi IS NOT NULL"),
        one("label", ["labs"], "list_contains(c.labs, p.lab)", "labs IS NOT NULL"),
        one("segment", ["seg"], "p.seg = c.seg", "TRUE"),
        one("land", ["nat"], "p.nat = c.nat", "nat IS NOT NULL"),
        "SELECT 'maand', -log2(count(*) OVER (PARTITION BY mo) / count(*) OVER ()) FROM cons"]
    return f"""WITH {POP}, {CONS}, b AS ({' UNION ALL '.join(parts)})
SELECT kenmerk, round(quantile_cont(bits, 0.5), 9) AS bits_mediaan, round(max(bits), 9) AS bits_max,
  kenmerk = 'maand' AS geschat FROM b GROUP BY kenmerk"""


def remaining_bits(spark, d):
    a = assess(dataset(spark, d), qids(), population(spark, d))
    return explain.remaining_bits(a).select("record_id", F.round("bits_resterend", 9)
                                            .alias("bits_resterend"))


REMAINING = risk() + """ SELECT id AS record_id,
  CASE WHEN status <> 'geen_match' THEN round(log2(greatest(k, 1)::DOUBLE), 9) END AS bits_resterend
  FROM res"""


def insider_columns(spark, d):
    """Which columns of a wide measurement table point to another holder of the same series."""
    e = table(spark, d, "events")
    wide = e.select("event_id", F.col("value").alias("gas_flow__m3"),
                    F.col("value").alias("boiler_temp__degC"), F.col("event_type").alias("thermostat_mode"),
                    F.col("event_type").alias("heeft_warmtepomp__bool"),
                    (F.col("event_id") % 3).alias("pv_status"),
                    F.get_json_object("props", "$.k").alias("p1_meter"))
    return explain.insider_sources(wide, wide.columns)


def _insider_sql():
    columns = {"event_id": "event_id", "gas_flow__m3": "value", "boiler_temp__degC": "value", "thermostat_mode": "event_type",
               "heeft_warmtepomp__bool": "event_type", "pv_status": "event_id % 3",
               "p1_meter": "json_extract_string(props, '$.k')"}
    cells = " UNION ALL ".join(f"SELECT '{c}' AS kolom, ({e})::VARCHAR AS v FROM events" for c, e in columns.items())
    party = "".join(f" WHEN regexp_matches(naam, '{p}') THEN '{who}'" for p, who in explain.HOLDERS)
    return f"""WITH c AS ({cells}), s AS (SELECT kolom, regexp_replace(lower(kolom), '__.*$', '') AS naam, lower(kolom) AS klein,
   count(TRY_CAST(v AS DOUBLE)) / count(*) AS deel, count(DISTINCT TRY_CAST(v AS DOUBLE)) AS n FROM c GROUP BY kolom)
SELECT * FROM (SELECT CASE{party} END AS partij, kolom FROM s WHERE deel >= 0.8 AND n >= 10
  AND NOT regexp_matches(klein, '{explain.NO_SERIES}')) WHERE partij IS NOT NULL"""


# --- rounding --------------------------------------------------------------------------------------------

def group_sizes(spark, d):
    grid = rounding.schemes({"price": [1000.0, 25000.0, 100000.0], "yr": [1.0, 5.0]})
    out = rounding.group_sizes(population(spark, d), grid, exact=["seg"])
    return out.withColumns({c: F.round(c, 9) for c in (
        "aandeel_te_klein", "bits_onthuld", "bits_resterend")})


def _group_sql():
    parts = []
    nr = 0
    for ps in (1000.0, 25000.0, 100000.0):
        for ys in (1.0, 5.0):
            parts.append(f"""SELECT {nr} AS schema_nr, {ps}::DOUBLE AS stap_price, {ys}::DOUBLE AS stap_yr, n FROM
 (SELECT count(*) AS n FROM pop GROUP BY floor(price / {ps} + 0.5), floor(yr / {ys} + 0.5), seg)""")
            nr += 1
    return f"""WITH {POP}, g AS ({' UNION ALL '.join(parts)}),
 c AS (SELECT *, sum(n) OVER (PARTITION BY schema_nr ORDER BY n ROWS UNBOUNDED PRECEDING) AS cum,
         sum(n) OVER (PARTITION BY schema_nr) AS tot FROM g)
SELECT schema_nr, stap_price, stap_yr, sum(n)::BIGINT AS woningen,
  round(sum(CASE WHEN n < 11 THEN n ELSE 0 END) / sum(n), 9) AS aandeel_te_klein,
  sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)::BIGINT AS uniek,
  min(n) FILTER (cum >= tot / 2.0)::DOUBLE AS groep_mediaan, count(*) AS groepen,
  round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) AS bits_onthuld,
  round(sum(n * log2(n)) / sum(n), 9) AS bits_resterend
FROM c GROUP BY schema_nr, stap_price, stap_yr"""


def rainbow(spark, d):
    return rounding.rainbow(population(spark, d), {"price": 25000.0, "yr": 2.0}, ["seg", "lab"])


RAINBOW = f"""WITH {POP} SELECT md5(concat_ws('|', CAST(floor(price / 25000.0 + 0.5) AS BIGINT),
  CAST(floor(yr / 2.0 + 0.5) AS BIGINT), seg, lab)) AS hash, count(*) AS n
  FROM pop WHERE lab IS NOT NULL GROUP BY 1"""


def rainbow_lookup(spark, d):
    pop = population(spark, d)
    steps = {"price": 25000.0, "yr": 2.0}
    t = rounding.rainbow(pop, steps, ["seg"])
    rec = pop_rows(spark, d).where("st = 'F'").select("id", "price", "yr", "seg")
    return rounding.lookup(rec, t, steps, ["seg"]).select("id", "n")


RAINBOW_LOOKUP = f"""WITH {POP}, g AS (SELECT floor(price / 25000.0 + 0.5) AS b, floor(yr / 2.0 + 0.5) AS y,
   seg, count(*) AS n FROM pop GROUP BY ALL)
SELECT id, n FROM pop p JOIN g ON floor(price / 25000.0 + 0.5) = b AND floor(yr / 2.0 + 0.5) = y
  AND p.seg = g.seg WHERE st = 'F'"""


def rainbow_metadata(spark, d):
    pop = population(spark, d).within(Scope({"reg": {"EUROPE", "ASIA"}}, description="two regions"))
    steps = {"price": 25000.0}
    return rounding.rainbow_metadata(rounding.rainbow(pop, steps, ["seg"]), pop, steps, ["seg"])


RAINBOW_META = f"""WITH {POP} SELECT 'price per 25000' AS stappen, 'seg' AS exact, 'two regions' AS afbakening,
  sum(n)::BIGINT AS woningen, count(*) AS groepen, 'orders test' AS bronnen
 FROM (SELECT count(*) AS n FROM pop WHERE reg IN ('EUROPE', 'ASIA')
       GROUP BY floor(price / 25000.0 + 0.5), seg)"""


def sensitive_norm(spark, d):
    """delta judged as well: taking part is itself sensitive."""
    a = assess(dataset(spark, d), qids("jaar", "segment", "land"), population(spark, d),
               Threshold.norm(0.09, sensitive=True))
    return a.groupBy("status").agg(F.count(F.lit(1)).alias("records"),
                                   F.count_if(F.col("delta") > 0.09).alias("delta_te_hoog"))


SENSITIVE = f"""WITH {POP}, {CONS}, classes AS (SELECT ylo, yhi, seg, nat, count(*) AS f FROM cons GROUP BY ALL),
 k AS (SELECT f, (SELECT count(*) FROM pop p WHERE (c.ylo IS NULL OR p.yr >= c.ylo)
   AND (c.yhi IS NULL OR p.yr <= c.yhi) AND p.seg = c.seg AND (c.nat IS NULL OR p.nat = c.nat)) AS n
   FROM classes c)
SELECT CASE WHEN n = 0 THEN 'geen_match' WHEN n < 11 OR f / n > 0.09 OR f > n THEN 'risico' ELSE 'ok' END AS status,
  sum(f)::BIGINT AS records, sum(CASE WHEN n = 0 OR f / n > 0.09 THEN f ELSE 0 END)::BIGINT AS delta_te_hoog
FROM k GROUP BY 1"""


def shortest_lists(spark, d):
    """Per record the shorter of two candidate lists: with and without the label."""
    pop, ds = population(spark, d), dataset(spark, d)
    out = None
    for name, names in (("a_met_label", ("jaar", "label", "segment", "land")),
                        ("b_zonder_label", ("jaar", "segment", "land"))):
        a = assess(ds, qids(*names), pop).select(
            F.col("record_id").alias("record"), "k_populatie", F.lit(name).alias("scenario"))
        out = a if out is None else out.unionByName(a)
    return report.shortest_lists(out)


SHORTEST = f"""WITH {POP}, {CONS}, c1 AS (SELECT DISTINCT ylo, yhi, labs, seg, nat FROM cons),
 k AS (SELECT c.*, (SELECT count(*) FROM pop p WHERE (c.ylo IS NULL OR p.yr >= c.ylo)
    AND (c.yhi IS NULL OR p.yr <= c.yhi) AND p.seg = c.seg AND (c.nat IS NULL OR p.nat = c.nat)
    AND (c.labs IS NULL OR list_contains(c.labs, p.lab))) AS n1,
   (SELECT count(*) FROM pop p WHERE (c.ylo IS NULL OR p.yr >= c.ylo)
    AND (c.yhi IS NULL OR p.yr <= c.yhi) AND p.seg = c.seg AND (c.nat IS NULL OR p.nat = c.nat)) AS n2 FROM c1 c)
SELECT s.id AS record, least(n1, n2) AS k_populatie,
  CASE WHEN n1 <= n2 THEN 'a_met_label' ELSE 'b_zonder_label' END AS scenario
FROM cons s JOIN k ON s.ylo IS NOT DISTINCT FROM k.ylo AND s.yhi IS NOT DISTINCT FROM k.yhi
  AND s.labs IS NOT DISTINCT FROM k.labs AND s.seg = k.seg AND s.nat IS NOT DISTINCT FROM k.nat"""


def scoped_size(spark, d):
    pop = population(spark, d).within(Scope({"yr": (1996.0, None)}, {"lab": {"5-LOW"}}))
    return pop.rows().groupBy("reg").agg(F.count(F.lit(1)).alias("n"))


SCOPED = f"""WITH {POP} SELECT reg, count(*) AS n FROM pop WHERE yr >= 1996
  AND NOT coalesce(lab = '5-LOW', FALSE) GROUP BY reg"""


_base = SELECT.format(est="FALSE")
QUERIES = {
    "assess_register": (assess_register, risk() + _base),
    "assess_blocks": (assess_blocks, risk() + _base),
    "assess_unknown_matches": (assess_unknown_matches, risk(unknown=True) + _base),
    "assess_scoped": (assess_scoped, risk(scope="yr BETWEEN 1996 AND 2000 AND seg IN ('BUILDING', "
                      "'FURNITURE', 'MACHINERY') AND NOT coalesce(lab = '5-LOW', FALSE)") + _base),
    "assess_insider": (assess_insider, risk(share=SHARE) + SELECT.format(est="TRUE")),
    "assess_sensitive": (sensitive_norm, SENSITIVE),
    "assess_summary": (assess_summary, risk() + """ SELECT count(*) AS records,
  count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'risico') AS risico,
  count(*) FILTER (status = 'geen_match') AS geen_match,
  min(k) FILTER (status <> 'geen_match')::DOUBLE AS k_min,
  round(max(delta) FILTER (status <> 'geen_match'), 9) AS delta_max,
  count(*) FILTER (status <> 'geen_match' AND delta >= 0.5) AS delta_signalen,
  count(*) FILTER (f > big_f) AS inconsistent,
  quantile_cont(k, 0.5) FILTER (status <> 'geen_match')::DOUBLE AS k_mediaan FROM res"""),
    "assess_numeric_only": (numeric_only, NUMERIC_ONLY),
    "population_scoped": (scoped_size, SCOPED),
    "constraint_table": (constraint_table, CONSTRAINT_TABLE),
    "constraint_hull": (constraint_hull, CONSTRAINT_HULL),
    "constraint_reading": (constraint_reading, CONSTRAINT_READING),
    "constraint_narrowest": (narrowest_class, NARROWEST),
    "clean_stations": (clean_stations, CLEAN_STATIONS),
    "clean_types": (clean_types, CLEAN_TYPES),
    "address_keys": (address_keys, ADDRESS_KEYS),
    "panel_totals": (panel_totals, PANEL),
    "class_texts": (class_texts, CLASS_TEXTS),
    "value_sets": (value_sets, VALUE_SETS),
    "candidate_lists": (candidate_lists, CANDIDATES),
    "shortest_lists": (shortest_lists, SHORTEST),
    "k_histogram": (k_histogram, K_HISTOGRAM),
    "failure_reasons": (failure_reasons, FAILURES),
    "publishable_records": (publishable_records, PUBLISHABLE),
    "scenario_comparison": (scenario_comparison, _scenario_sql()),
    "candidate_areas": (candidate_areas, CANDIDATE_AREAS),
    "zone_risk": (zone_risk, ZONE_RISK),
    "information_bits": (information_bits, _bits_sql()),
    "remaining_bits": (remaining_bits, REMAINING),
    "insider_columns": (insider_columns, _insider_sql()),
    "rounding_groups": (group_sizes, _group_sql()),
    "rainbow_table": (rainbow, RAINBOW),
    "rainbow_lookup": (rainbow_lookup, RAINBOW_LOOKUP),
    "rainbow_metadata": (rainbow_metadata, RAINBOW_META),
}
