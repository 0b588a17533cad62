"""Coarser versions of the dataset, their cost, and how columns should be read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import NUMERIC, Knowledge, Qid, custom
from ..functions import constraints as con
from ..operators import detect, reading
from ..operators.assess import Threshold
from ..operators.generalize import (Bin, Edges, Group, LocationUp, Noise, Suppress, information_loss,
                                    suggest, tradeoff)
from .risk_queries import _text
from .views import CONS, POP, SPECS, dataset, pop_rows, population, qids, risk, table

ACTIONS = [Bin("jaar", 2, below=1997, above=2000),
           Group("label", (("1-URGENT", "2-HIGH"), ("2-HIGH", "3-MEDIUM"))),
           LocationUp("land", "regio", SPECS["regio"]), Suppress("prijs")]


def generalise(spark, d):
    """Three columns rewritten as they would be published."""
    ds, q = dataset(spark, d), qids()
    for a in ACTIONS[:3]:
        ds, q = a.apply(ds, q, population(spark, d))
    return ds.select("record_id", "jaar", "label", "land")


BIN_LO = ("CASE WHEN ylo IS NULL OR ylo < 1997 THEN NULL ELSE greatest(floor(ylo / 2) * 2, 1997) END")
BIN_HI = ("CASE WHEN yhi IS NULL OR yhi >= 2000 THEN NULL ELSE least(floor(yhi / 2) * 2 + 1, 1999) END")
# the Bin above: tails decided on the published bounds, regular classes clipped at the tails
BINNED = f"""binned AS (SELECT * EXCLUDE (ylo, yhi),
  CASE WHEN ylo IS NULL AND yhi IS NULL THEN NULL WHEN yhi < 1997 THEN NULL WHEN ylo >= 2000 THEN 2000
       ELSE {BIN_LO} END AS ylo,
  CASE WHEN ylo IS NULL AND yhi IS NULL THEN NULL WHEN yhi < 1997 THEN 1996 WHEN ylo >= 2000 THEN NULL
       ELSE {BIN_HI} END AS yhi, (ylo IS NOT NULL OR yhi IS NOT NULL) AS yk FROM cons)"""
GROUPED = """grouped AS (SELECT * EXCLUDE (labs), CASE WHEN labs IS NULL THEN NULL
  WHEN list_has_any(labs, ['1-URGENT', '2-HIGH', '3-MEDIUM']) THEN list_sort(list_distinct(list_concat(labs,
    CASE WHEN list_has_any(labs, ['1-URGENT', '2-HIGH']) THEN ['1-URGENT', '2-HIGH', '3-MEDIUM']
         ELSE ['2-HIGH', '3-MEDIUM'] END))) ELSE labs END AS labs FROM binned)"""
GENERALISE = f"""WITH {POP}, {CONS}, {BINNED}, {GROUPED}
SELECT id AS record_id, nullif({_text('ylo', 'yhi')}, '') AS jaar, array_to_string(labs, '|') AS label,
  (SELECT max(reg) FROM pop WHERE pop.nat = g.nat) AS land FROM grouped g"""


def generalise_edges(spark, d):
    ds, _ = Edges("jaar", (1996, 1998, 2000)).apply(dataset(spark, d), qids())
    return ds.select("record_id", "jaar")


EDGES = f"""WITH {POP}, {CONS}, e AS (SELECT id, ylo IS NULL AND yhi IS NULL AS u,
  CASE WHEN ylo >= 2000 THEN 2000 WHEN ylo >= 1998 THEN 1998 WHEN ylo >= 1996 THEN 1996 END AS lo,
  CASE WHEN yhi < 1996 THEN 1995 WHEN yhi < 1998 THEN 1997 WHEN yhi < 2000 THEN 1999 END AS hi FROM cons)
SELECT id AS record_id, CASE WHEN NOT u THEN nullif({_text('lo', 'hi')}, '') END AS jaar FROM e"""


def generalise_noise(spark, d):
    q = [Qid("maand", custom("maand", NUMERIC, Knowledge.REGISTER, population_column="mo"))]
    ds, after = Noise("maand", 2.0, seed=5).apply(dataset(spark, d), q)
    return ds.select("record_id", "maand", F.lit(after[0].tolerance).alias("tolerantie"))


NOISE = f"""WITH {POP} SELECT id AS record_id, CAST(round_even(mo + ((('0x' || substr(md5('5|' || id), 1, 8))::BIGINT
  / 4294967296.0) * 2 - 1) * 2.0, 0) AS BIGINT)::VARCHAR AS maand, 2.5::DOUBLE AS tolerantie FROM pop WHERE st = 'F'"""


def most_frequent(spark, d):
    return population(spark, d).most_frequent("lab", "cust").withColumnsRenamed(
        {"key": "cust", "value": "label"})


MOST_FREQUENT = f"""WITH {POP}, n AS (SELECT cust, lab, count(*) AS n FROM pop WHERE lab IS NOT NULL GROUP BY ALL)
SELECT cust::VARCHAR AS cust, lab AS label FROM n
QUALIFY row_number() OVER (PARTITION BY cust ORDER BY n DESC, lab) = 1"""


def loss(spark, d):
    """Information lost by the classes and groups, relative to the dataset as delivered."""
    ds, q = dataset(spark, d), qids("jaar", "label", "segment")
    out, after = ds, q
    for a in ACTIONS[:2]:
        out, after = a.apply(out, after, None)
    return information_loss(out, after, ds, original_qids=q).select(
        F.round("informatieverlies", 9).alias("informatieverlies"))


def _width(lo, hi):
    return f"CASE WHEN {lo} IS NULL OR {hi} IS NULL THEN 1.0 ELSE least(1.0, ({hi} - {lo}) / span) END"


LOSS = f"""WITH {POP}, {CONS}, {BINNED}, {GROUPED},
 sp AS (SELECT max(yhi) - min(ylo) AS span, (SELECT count(DISTINCT v) FROM
   (SELECT unnest(labs) AS v FROM cons)) AS nl FROM cons),
 x AS (SELECT g.id, yk, c.labs IS NULL AS lu, {_width('g.ylo', 'g.yhi')} AS yn, {_width('c.ylo', 'c.yhi')} AS yw,
   (len(g.labs) - 1) / (nl - 1) AS ln, (len(c.labs) - 1) / (nl - 1) AS lw
  FROM grouped g JOIN cons c USING (id), sp),
 r AS (SELECT CASE WHEN NOT yk OR yw >= 1 THEN 0 ELSE greatest(0, least(1, (yn - yw) / (1 - yw))) END AS a,
   CASE WHEN lu OR lw >= 1 THEN 0 ELSE greatest(0, least(1, (ln - lw) / (1 - lw))) END AS b FROM x)
SELECT round((avg(a) + avg(b) + 0) / 3, 9) AS informatieverlies FROM r"""


def tradeoff_steps(spark, d):
    t = tradeoff(dataset(spark, d), qids(), population(spark, d), ACTIONS)
    return t.select("nr", "ok", "risico", "geen_match", F.round("publiceerbaar_pct", 6)
                    .alias("publiceerbaar_pct"), "k_mediaan")


def _tradeoff_sql():
    one = """SELECT {nr} AS nr, count(*) FILTER (status = 'ok') AS ok,
  count(*) FILTER (status = 'risico') AS risico, count(*) FILTER (status = 'geen_match') AS geen_match,
  round(100.0 * count(*) FILTER (status = 'ok') / count(*), 6) AS publiceerbaar_pct,
  quantile_cont(k, 0.5) FILTER (status <> 'geen_match')::DOUBLE AS k_mediaan FROM res"""
    start = CONS.replace("cons AS", "cons0 AS", 1)
    b = BINNED.replace("FROM cons)", "FROM cons0)")
    reg = """, lifted AS (SELECT * EXCLUDE (nat), (SELECT max(reg) FROM pop WHERE pop.nat = g.nat) AS nat FROM grouped g)"""
    cols = "SELECT id, mo, {y}, {p}, labs, seg, nat FROM {t}"
    keep_y, keep_p = "ylo, yhi", "plo, phi"
    steps = [CONS, start + ", " + b + ", cons AS (" + cols.format(y=keep_y, p=keep_p, t="binned") + ")",
             start + ", " + b + ", " + GROUPED + ", cons AS (" + cols.format(
                 y=keep_y, p=keep_p, t="grouped") + ")",
             start + ", " + b + ", " + GROUPED + reg + ", cons AS (" + cols.format(
                 y=keep_y, p=keep_p, t="lifted") + ")",
             start + ", " + b + ", " + GROUPED + reg + ", cons AS (" + cols.format(
                 y=keep_y, p="NULL::DOUBLE AS plo, NULL::DOUBLE AS phi", t="lifted") + ")"]
    parts = []
    for nr, c in enumerate(steps):
        sql = risk(cons=c)
        if nr >= 3:
            sql = sql.replace("p.nat = c.nat", "p.reg = c.nat")
        parts.append("SELECT * FROM (" + sql + " " + one.format(nr=nr) + ")")
    return " UNION ALL ".join(parts)


def suggested(spark, d):
    """The greedy search on year, label, segment and nation."""
    ladders = {"jaar": [Bin("jaar", 2), Bin("jaar", 4), Suppress("jaar")],
               "label": [ACTIONS[1], Suppress("label")],
               "segment": [Suppress("segment")],
               "land": [ACTIONS[2], Suppress("land")]}
    s = suggest(dataset(spark, d), qids("jaar", "label", "segment", "land"), population(spark, d),
                Threshold(0.05), target_share=0.95, max_steps=6, ladders=ladders)
    return s.steps.select("nr", "stap", "ok", "risico", "geen_match", F.round(
        "informatieverlies", 6).alias("informatieverlies"))


# --- reading -------------------------------------------------------------------------------------------

def class_neighbours(spark, d):
    return reading.neighbouring_classes(dataset(spark, d), qids("jaar", "prijs"), "record_id").select(
        "kolom", "lo", "hi", "lo_2", "hi_2", "soort")


NEIGHBOURS = f"""WITH {POP}, {CONS}, c AS (SELECT DISTINCT 'jaar' AS kolom, ylo::DOUBLE AS lo, yhi::DOUBLE AS hi, 1 AS u FROM cons
   WHERE (ylo IS NOT NULL OR yhi IS NOT NULL) AND ylo IS DISTINCT FROM yhi
  UNION ALL SELECT DISTINCT 'prijs', plo, phi, 0 FROM cons WHERE plo IS NOT NULL OR phi IS NOT NULL),
 p AS (SELECT *, lead(lo) OVER w AS lo_2, lead(hi) OVER w AS hi_2, lead(1) OVER w AS more FROM c
   WINDOW w AS (PARTITION BY kolom ORDER BY lo ASC NULLS FIRST, hi ASC NULLS LAST))
SELECT kolom, lo, hi, lo_2, hi_2, CASE WHEN hi IS NULL OR lo_2 IS NULL THEN 'overlap'
  WHEN u = 1 AND lo_2 = hi + 1 THEN 'aansluitend' WHEN lo_2 = hi THEN CASE WHEN u = 1 THEN 'raken'
  ELSE 'aansluitend' END WHEN lo_2 > hi THEN 'gaten' ELSE 'overlap' END AS soort FROM p WHERE more = 1"""


def _rounded(spark, d):
    p = pop_rows(spark, d)
    near = F.floor(F.col("price") / 25000 + 0.5).cast("bigint") * 25000
    return p.select(F.col("id").alias("record_id"), near.cast("string").alias("prijs"),
                    F.col("seg").alias("segment"), F.col("yr").cast("string").alias("jaar"),
                    (F.floor(F.col("price") / 7) * 7).cast("string").alias("zeven"))


def value_steps(spark, d):
    q = [Qid("prijs", SPECS["prijs"]), Qid("jaar", SPECS["jaar"]), Qid("zeven", SPECS["prijs"])]
    return reading.value_steps(_rounded(spark, d), q, "record_id").select(
        "kolom", "exact", "klassen", "stap")


VALUE_STEPS = f"""WITH {POP} SELECT 'prijs' AS kolom, count(DISTINCT floor(price / 25000 + 0.5)) AS exact,
   0::BIGINT AS klassen, 100.0::DOUBLE AS stap FROM pop
 UNION ALL SELECT 'jaar', count(DISTINCT yr), 0, 0.0 FROM pop
 UNION ALL SELECT 'zeven', count(DISTINCT floor(price / 7)), 0, 0.0 FROM pop"""


def reading_sensitivity(spark, d):
    ds = _rounded(spark, d)
    spec = custom("prijs", NUMERIC, Knowledge.REGISTER, population_column="price", integer=False)
    q = [Qid("prijs", spec, reading=con.Reading(25000.0)), Qid("segment", SPECS["segment"])]
    studies = {"prijs": reading.Study("prijs", False, exact=9, step=25000.0)}
    return reading.sensitivity(ds, q, population(spark, d), Threshold(), Knowledge.REGISTER, studies)


def _sensitivity_sql():
    def one(text, lo, hi):
        return f"""SELECT 'prijs' AS kolom, 'rounded to 25000, to the nearest' AS lezing, '{text}' AS alternatief,
  (SELECT count(*) FROM pop r WHERE (SELECT count(*) FROM pop p WHERE p.seg = r.seg
     AND p.price BETWEEN {lo} AND {hi}) BETWEEN 11 AND 1000000000 AND (SELECT count(*) FROM pop q
     WHERE q.seg = r.seg AND floor(q.price / 25000 + 0.5) = floor(r.price / 25000 + 0.5)) <=
     (SELECT count(*) FROM pop p WHERE p.seg = r.seg AND p.price BETWEEN {lo} AND {hi})) AS publiceerbaar"""

    b = "floor(r.price / 25000 + 0.5) * 25000"
    return f"WITH {POP} " + one("rounded to 25000, down", b, f"{b} + 25000") + " UNION ALL " + one(
        "as published", b, b)


# --- detection -----------------------------------------------------------------------------------------

def _wide(spark, d):
    """Customers as a data holder might deliver them."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("record_id"), F.concat(F.lit("c"), k.cast("string"), F.lit("@mail.nl")).alias("contact"),
        F.concat((k % 8000 + 1000).cast("string"), F.lit("AB")).alias("waar"),
        (F.col("c_nationkey") + 1960).cast("string").alias("wanneer"),
        F.get(F.lit(["A", "B", "C", "G"]), (k % 4).cast("int")).alias("klasse"),
        F.get(F.lit(["vrijstaand", "hoekwoning", "flat"]), (k % 3).cast("int")).alias("soort"),
        F.col("c_nationkey").cast("string").alias("gemeente"),
        F.concat(F.lit("n"), (F.col("c_nationkey") % 5).cast("string")).alias("afgeleid"),
        F.col("c_acctbal").cast("string").alias("saldo"),
        F.when(k % 2 == 0, F.col("c_mktsegment")).alias("segment"))


def column_profile(spark, d):
    p = detect.profile(_wide(spark, d), "record_id")
    return p.select("kolom", "ingevuld", "getallen", "verschillend", "minimum", "maximum",
                    F.round("lengte_mediaan", 6).alias("lengte_mediaan"),
                    *[F.round(f"share_{s}", 9).alias(s) for s in ("email", "pc6", "label", "type", "pc4")])


PROFILE = """WITH w AS (SELECT c_custkey AS rid, 'c' || c_custkey || '@mail.nl' AS contact,
  (c_custkey % 8000 + 1000) || 'AB' AS waar, (c_nationkey + 1960)::VARCHAR AS wanneer,
  ['A', 'B', 'C', 'G'][c_custkey % 4 + 1] AS klasse,
  ['vrijstaand', 'hoekwoning', 'flat'][c_custkey % 3 + 1] AS soort, c_nationkey::VARCHAR AS gemeente,
  'n' || (c_nationkey % 5) AS afgeleid, c_acctbal::VARCHAR AS saldo,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer),
 u AS (UNPIVOT w ON contact, waar, wanneer, klasse, soort, gemeente, afgeleid, saldo, segment
       INTO NAME kolom VALUE v),
 s AS (SELECT kolom, avg(CASE WHEN kolom = 'contact' THEN 1.0 ELSE 0.0 END) AS email,
   avg(CASE WHEN kolom = 'waar' THEN 1.0 ELSE 0.0 END) AS pc6,
   avg(CASE WHEN v IN ('A', 'B', 'C', 'G') THEN 1.0 ELSE 0.0 END) AS label,
   avg(CASE WHEN kolom = 'soort' THEN 1.0 ELSE 0.0 END) AS type,
   avg(CASE WHEN regexp_matches(v, '^[0-9]{4}$') THEN 1.0 ELSE 0.0 END) AS pc4 FROM u GROUP BY kolom)
SELECT u.kolom, count(*) AS ingevuld, count(TRY_CAST(v AS DOUBLE)) AS getallen, count(DISTINCT v) AS verschillend,
  min(TRY_CAST(v AS DOUBLE)) AS minimum, max(TRY_CAST(v AS DOUBLE)) AS maximum,
  round(median(length(v)), 6) AS lengte_mediaan, round(max(email), 9) AS email, round(max(pc6), 9) AS pc6,
  round(max(label), 9) AS label, round(max(type), 9) AS type, round(max(pc4), 9) AS pc4
FROM u JOIN s USING (kolom) GROUP BY u.kolom"""


def detected_roles(spark, d):
    found = detect.detect(_wide(spark, d), "record_id")
    return detect.to_frame(spark, found).select("kolom", "rol", "qid", "zekerheid")


ROLES = """SELECT * FROM (VALUES ('contact', 'direct', '', 0.9::DOUBLE), ('waar', 'qid', 'postcode6', 0.9),
  ('wanneer', 'qid', 'bouwjaar', 0.4), ('klasse', 'qid', 'energielabel', 0.8), ('soort', 'qid', 'woningtype', 0.6),
  ('gemeente', 'qid', 'gemeente', 0.7), ('afgeleid', 'derived', 'bouwjaar', 0.7), ('saldo', 'measurement', '', 0.5),
  ('segment', 'measurement', '', 0.5)) t(kolom, rol, qid, zekerheid)"""


def dependencies(spark, d):
    p = pop_rows(spark, d).select("nat", "reg", "seg", F.col("cust").alias("klant"), "yr")
    return detect.dependencies(p, ["nat", "klant", "seg"], ["reg", "yr", "seg"]).where("bron <> kolom")


DEPENDENCIES = f"""WITH {POP}, c AS (SELECT 'nat' AS bron, 'reg' AS kolom, nat AS s, reg AS c FROM pop
  UNION ALL SELECT 'nat', 'yr', nat, yr::VARCHAR FROM pop UNION ALL SELECT 'nat', 'seg', nat, seg FROM pop
  UNION ALL SELECT 'klant', 'reg', cust::VARCHAR, reg FROM pop UNION ALL SELECT 'klant', 'yr', cust::VARCHAR, yr::VARCHAR FROM pop
  UNION ALL SELECT 'klant', 'seg', cust::VARCHAR, seg FROM pop UNION ALL SELECT 'seg', 'reg', seg, reg FROM pop
  UNION ALL SELECT 'seg', 'yr', seg, yr::VARCHAR FROM pop),
 g AS (SELECT bron, kolom, s, count(DISTINCT c) AS k, count(*) AS n FROM c GROUP BY ALL)
SELECT g.bron, g.kolom FROM g JOIN (SELECT bron, kolom, count(DISTINCT c) AS nc FROM c GROUP BY ALL) t USING (bron, kolom)
 GROUP BY ALL HAVING max(k) <= 1 AND count(*) < sum(n) AND count(*) >= 2 AND sum(n) >= 5 AND max(nc) <= count(*)"""


QUERIES = {
    "generalise_columns": (generalise, GENERALISE),
    "generalise_edges": (generalise_edges, EDGES),
    "generalise_noise": (generalise_noise, NOISE),
    "most_frequent_value": (most_frequent, MOST_FREQUENT),
    "information_loss": (loss, LOSS),
    "tradeoff_steps": (tradeoff_steps, _tradeoff_sql()),
    "suggested_steps": (suggested, None),
    "class_neighbours": (class_neighbours, NEIGHBOURS),
    "value_steps": (value_steps, VALUE_STEPS),
    "reading_sensitivity": (reading_sensitivity, _sensitivity_sql()),
    "column_profile": (column_profile, PROFILE),
    "detected_roles": (detected_roles, ROLES),
    "column_dependencies": (dependencies, DEPENDENCIES),
}
