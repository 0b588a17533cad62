"""Signatures of dwellings, sun and wind, and tracing series to their source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.numbers import uniform
from ..operators import publish, trace
from ..operators import signature as sig
from ..operators.assess import Threshold
from ..operators.population import Population
from ..session import cut
from .place_queries import HAVERSINE, PTS, _u, customers
from .views import table

# --- dwellings: one per order, with attributes from its key -----------------------------------------

TYPES = ["vrijstaand", "twee_onder_een_kap", "hoekwoning", "tussenwoning", None, "appartement"]


def dwellings(spark, d):
    i = F.col("o_orderkey")

    def pick(options, n):
        out = F.lit(None).cast("string")
        for j, o in enumerate(options):
            if o is not None:
                out = F.when(i % n == j, o).otherwise(out)
        return out

    return table(spark, d, "orders").select(
        i.cast("string").alias("vbo_id__str"), F.concat((i % 500 + 1000).cast("string"), F.lit("AB"))
        .alias("postcode6__str"), (i % 20 + 1).cast("string").alias("huisnummer__str"),
        F.lit(None).cast("string").alias("huisletter__str"),
        F.lit(None).cast("string").alias("toevoeging__str"),
        (i * 7 % 125 + 1900).cast("int").alias("bouwjaar__yr"), (i % 140 + 60).alias("oppervlakte__m2"),
        pick(TYPES, 6).alias("woningtype__cat"), F.when(i % 8 == 0, 3).otherwise(1).alias("pand_woningen__0"),
        (i % 8 != 0).alias("eengezins__bool"), (i % 3 > 0).alias("aaneengebouwd__bool"),
        pick(["schuin", "plat"], 3).alias("daktype__cat"),
        F.when(i % 4 > 0, i % 4).alias("bouwlagen__0"), (i % 90 + 90.0).alias("opp_buitenmuur__m2"),
        F.when(i % 11 > 0, i % 30 + 40.0).alias("opp_grond__m2"), (i % 20 * 1.0).alias("opp_dak_plat__m2"),
        (i % 25 + 50.0).alias("opp_dak_schuin__m2"), (i % 70 * 1.0).alias("opp_scheidingsmuur__m2"),
        pick(["A", "A+", "C", "G"], 5).alias("energielabel__cat"),
        F.when(i % 3 == 0, i % 200 + 50.0).alias("warmtebehoefte__kWh_m_2_a_1"),
        (i % 3 == 0).alias("nta8800__bool"), F.when(i % 7 > 0, i % 10 / 10.0 + 1.5).alias("compactheid__m2_m_2"),
        F.when(i % 5 > 0, i % 140 + 55.0).alias("label_oppervlakte__m2"),
        F.col("o_orderpriority").alias("gemeente__cat"),
        *[(i * (j + 1) % 15 + 10.0).alias(c) for j, c in enumerate(sig.FACADES)],
        *[(i % 5 * 1.0).alias(c) for c in sig.SIDE_FACADES])


def references(spark, d):
    """Reference dwellings per type and period, from the mean prices of the parts."""
    n = len(PERIODS)
    p = table(spark, d, "part").groupBy((F.col("p_partkey") % (4 * n)).alias("nr")).agg(
        (F.avg("p_size") / 100).alias("b"))
    b = F.col("b")

    def levels(*values):
        return F.array(*[F.lit(v) + b * 0.1 for v in values])

    return p.select(
        F.get(F.lit(TYPES[:4]), (F.col("nr") % 4).cast("int")).alias("woningtype"),
        F.get(F.lit(list(PERIODS)), F.floor(F.col("nr") / 4).cast("int")).alias("periode"),
        F.concat(F.lit("ref"), F.col("nr").cast("string")).alias("id"),
        levels(1.6, 0.7, 0.4, 0.2).alias("u_gevel"), levels(2.9, 2.0, 1.2, 0.8).alias("u_raam"),
        levels(3.4, 2.0, 1.4, 1.0).alias("u_deur"), levels(1.2, 0.7, 0.4, 0.2).alias("u_vloer"),
        levels(1.5, 0.6, 0.3, 0.15).alias("u_dak"), F.lit([0.85, 0.75, 0.6, 0.4]).alias("g"),
        F.array(*[F.lit(v) - b * 5 for v in (260.0, 150.0, 80.0, 45.0)]).alias("q"),
        F.lit(1.0).alias("b_vloer"), (0.2 + b * 0.1).alias("raamdeel"), (6.0 + b).alias("deur"),
        (2.0 + b).alias("compactheid"), F.lit(0.35).alias("deel_gevel"), F.lit(0.12).alias("deel_raam"),
        F.lit(0.03).alias("deel_deur"), F.lit(0.2).alias("deel_vloer"), F.lit(0.3).alias("deel_dak"))


def _sig(spark, d, method, refs=None):
    out = sig.compute(dwellings(spark, d), method, refs)
    return out.select("vbo_id__str", *sig.OUTPUT_COLUMNS)


def _steps(c, table_):
    return "CASE " + " ".join(f"WHEN {c} >= {s} THEN {v}" for s, v in reversed(table_)) + " END"


def _ref(kind, period, column):
    """The reference value per type and period, the nearest period where one is missing."""
    starts = dict(sig.PERIODS)
    out = []
    for k in sig.SINGLE_FAMILY:
        have = [p for p, _ in sig.PERIODS if (k, p) in sig.REFERENCE]
        for p, s in sig.PERIODS:
            near = p if p in have else min(have, key=lambda q: abs(starts[q] - s))
            out.append(f"WHEN {kind} = '{k}' AND {period} = '{p}' THEN {sig.REFERENCE[k, near][column]}")
    return "CASE " + " ".join(out) + " END::DOUBLE"


def signature_sql(mwa: bool) -> str:
    year = "y"
    adj = (lambda u: f"(1 / (1 / ({u}) + 0.15))") if mwa else (lambda u: f"({u})")
    window = 0.9 if mwa else 1.0
    ground = 0.7 * (0.7 if mwa else 1.0)
    rc = {p: _steps(year, t) for p, t in sig.RC_BY_YEAR.items()}
    leak = 0.5 if mwa else 1.0
    return f"""WITH b AS (SELECT o_orderkey AS i, o_orderkey * 7 % 125 + 1900 AS y, o_orderkey % 140 + 60 AS ag,
   CASE o_orderkey % 6 WHEN 0 THEN 'vrijstaand' WHEN 1 THEN 'twee_onder_een_kap' WHEN 2 THEN 'hoekwoning' WHEN 3 THEN 'tussenwoning'
     ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'vrijstaand' WHEN (o_orderkey % 70)::DOUBLE / (o_orderkey % 70 + o_orderkey % 90 + 90) < 0.44
       THEN 'twee_onder_een_kap' ELSE 'tussenwoning' END END AS kind,
   o_orderkey % 90 + 90.0::DOUBLE AS ow, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 30 + 40.0::DOUBLE END AS gr,
   o_orderkey % 20 + o_orderkey % 25 + 50.0::DOUBLE AS roof, o_orderkey % 8 <> 0 AS single, o_orderkey % 3 = 1 AS flat,
   CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 ELSE 2 END AS cls FROM orders),
 p AS (SELECT *, CASE WHEN y < 1946 THEN 'tot46' WHEN y < 1975 THEN 'tot65' WHEN y < 1992 THEN '75-91' WHEN y < 2006 THEN '92-05' ELSE '06-14' END AS per FROM b),
 r AS (SELECT *, {_ref('kind', 'per', 0)} AS frac, {_ref('kind', 'per', 1)} AS door, {_ref('kind', 'per', 2)} * {window} AS uw,
   {adj(f"1 / ({rc['gevel']} + 0.13 + 0.04)")}::DOUBLE AS ug, {adj(f"1 / ({rc['vloer']} + 0.17)")}::DOUBLE AS uv,
   {adj(f"1 / ({rc['dak']} + 0.10 + 0.04)")}::DOUBLE AS ud, {_steps(year, sig.DOOR_BY_YEAR)} * {window}::DOUBLE AS uu,
   {_steps(year, sig.GLASS_BY_YEAR)}::DOUBLE AS g, {_steps(year, sig.MASS_BY_YEAR)}::DOUBLE AS mass,
   {_steps(year, sig.AIR_BY_YEAR)} * CASE kind WHEN 'tussenwoning' THEN 1.0 WHEN 'vrijstaand' THEN 1.4 ELSE 1.2 END
     * CASE WHEN flat THEN 0.7 ELSE 1.0 END * {leak}::DOUBLE AS qv FROM p),
 a AS (SELECT *, ow * frac AS win, ow - ow * frac - door AS wall, gr * {ground}::DOUBLE AS grb FROM r),
 h AS (SELECT *, wall * ug + win * uw + door * uu + grb * uv + roof * ud AS h, mass * 1000 / 3600 * ag AS c,
   win * 0.7::DOUBLE * g * 0.9 * 0.9 * 0.731 + wall * (0.6 * 0.04) * ug * 0.731 + door * (0.6 * 0.04) * uu * 0.731 + roof * (0.6 * 0.04) * ud AS asol,
   qv * ag * pow(4.0::DOUBLE / 10.0, 0.67) / 1000.0 / sqrt(8.0::DOUBLE / 1.2) * 1e4 * CASE cls WHEN 1 THEN 0.23 WHEN 2 THEN 0.2877 ELSE 0.331 END AS ainf FROM a),
 o AS (SELECT *, single AND h > 0 AND wall > 0 AS ok FROM h)
SELECT i::VARCHAR AS vbo_id__str, CASE WHEN ok THEN round_even(h * 100, 0) / 100 END AS H__W_K_1,
  CASE WHEN ok THEN round_even(c * 10, 0) / 10 END AS C__Wh_K_1, CASE WHEN ok THEN round_even(c / h * 1000, 0) / 1000 END AS tau__h,
  CASE WHEN ok THEN round_even(asol * 1000, 0) / 1000 END AS Asol__m2, CASE WHEN ok THEN round_even(ainf * 10, 0) / 10 END AS Ainf__cm2 FROM o"""


PERIODS = ("< 1946", "< 1965", "1946–1964", "1965–1974", "1975–1991", "1992–2005", "2006–2014",
           "2015–2018")


def label_signature_sql(ep: bool) -> str:
    """The label-based methods: the reference dwelling at the level of the label, its windows by
    the direction of the walls."""
    def at(values, t="lv"):
        vals = f"[{', '.join(values)}]"
        return (f"CASE WHEN floor({t}) >= 3 THEN {values[3]} ELSE {vals}[floor({t})::INT + 1] * (1 - ({t} - floor({t}))) "
                f"+ {vals}[least(floor({t})::INT + 2, 4)] * ({t} - floor({t})) END")

    def ref(*values):
        return at([f"({v}::DOUBLE + b * 0.1)" for v in values])

    def adj(u):
        return f"(1 / (1 / ({u}) + 0.15))"

    q = [f"({v}::DOUBLE - b * 5)" for v in (260, 150, 80, 45)]
    seg = " ".join(f"WHEN {q[i + 1]} <= w AND w <= {q[i]} THEN {i} + ({q[i]} - w) / ({q[i]} - {q[i + 1]})"
                   for i in range(3))
    t = [f"(i * {j + 1} % 15 + 10.0::DOUBLE)" for j in range(8)]
    side = "(i % 5 * 1.0::DOUBLE)"                   # a side wall is never longer than the wall
    ws = [f"({x} - {side} + sw * {side})" for x in t]
    if ep:
        area = "compact * coalesce(agl, ag)"
        areas = (f"{area} * 0.12 AS win, {area} * 0.35 AS wall, {area} * 0.03 AS dr, {area} * 0.2 * 0.7 AS grb, "
                 f"{area} * 0.3 AS rf, coalesce(agl, ag) AS gbo")
    else:
        areas = ("ow * (0.2 + b * 0.1) AS win, ow - ow * (0.2 + b * 0.1) - (6.0 + b) AS wall, 6.0 + b AS dr, "
                 "gr * 0.7 AS grb, roof AS rf, ag AS gbo")
    o = [f"greatest((wall + win + dr) * {x} / tt - (win + dr) * {w} / wt, 0)" for x, w in zip(t, ws)]

    def mean(parts, total):
        return "(" + " + ".join(f"{x} * {r}" for x, r in zip(parts, sig.SECTOR_RATIO)) + f") / {total}"

    return f"""WITH rf AS (SELECT p_partkey % 32 AS nr, avg(p_size) / 100 AS b FROM part GROUP BY 1),
 d AS (SELECT o_orderkey AS i, o_orderkey * 7 % 125 + 1900 AS y, o_orderkey % 140 + 60 AS ag,
   CASE o_orderkey % 6 WHEN 0 THEN 'vrijstaand' WHEN 1 THEN 'twee_onder_een_kap' WHEN 2 THEN 'hoekwoning' WHEN 3 THEN 'tussenwoning'
     ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'vrijstaand' WHEN (o_orderkey % 70)::DOUBLE / (o_orderkey % 70 + o_orderkey % 90 + 90) < 0.44
       THEN 'twee_onder_een_kap' ELSE 'tussenwoning' END END AS kind,
   o_orderkey % 90 + 90.0::DOUBLE AS ow, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 30 + 40.0::DOUBLE END AS gr,
   o_orderkey % 20 + o_orderkey % 25 + 50.0::DOUBLE AS roof, o_orderkey % 8 <> 0 AS single, o_orderkey % 3 = 1 AS flat,
   CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 ELSE 2 END AS cls,
   CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 10 / 10.0::DOUBLE + 1.5 END AS compact,
   CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 140 + 55.0::DOUBLE END AS agl FROM orders),
 p AS (SELECT *, CASE WHEN y < 1946 AND kind IN ('hoekwoning', 'tussenwoning') THEN 0 WHEN y < 1965 AND kind NOT IN ('hoekwoning', 'tussenwoning') THEN 1
   WHEN y < 1965 THEN 2 WHEN y < 1975 THEN 3 WHEN y < 1992 THEN 4 WHEN y < 2006 THEN 5 WHEN y < 2015 THEN 6 ELSE 7 END AS per,
   CASE kind WHEN 'vrijstaand' THEN 0 WHEN 'twee_onder_een_kap' THEN 1 WHEN 'hoekwoning' THEN 2 ELSE 3 END AS kn FROM d),
 r AS (SELECT p.*, b, (i % 200 + 50.0::DOUBLE) * CASE WHEN compact > 0 THEN (2.0 + b) / compact ELSE 1 END AS w,
   CASE WHEN kind = 'vrijstaand' THEN 1.0 ELSE 0.5 END AS sw FROM p JOIN rf ON nr = per * 4 + kn),
 l AS (SELECT *, CASE WHEN i % 3 = 0 THEN CASE WHEN w >= {q[0]} THEN 0.0 WHEN w <= {q[3]} THEN 3.0 {seg} ELSE 1.0 END
   WHEN i % 5 = 1 THEN 2.0 WHEN i % 5 = 0 THEN 1.5 ELSE 1.0 END::DOUBLE AS lv FROM r),
 u AS (SELECT *, {adj(ref(1.6, 0.7, 0.4, 0.2))} AS ug, ({ref(2.9, 2.0, 1.2, 0.8)}) * 0.9 AS uw, ({ref(3.4, 2.0, 1.4, 1.0)}) * 0.9 AS uu,
   {adj(ref(1.2, 0.7, 0.4, 0.2))} AS uv, {adj(ref(1.5, 0.6, 0.3, 0.15))} AS ud,
   {at(['0.85::DOUBLE', '0.75', '0.6', '0.4'])} AS g, {areas}, {' + '.join(t)} AS tt, {' + '.join(ws)} AS wt,
   {_steps('y', sig.MASS_BY_YEAR)}::DOUBLE AS mass, {_steps('y', sig.AIR_BY_YEAR)} * CASE kind WHEN 'tussenwoning' THEN 1.0 WHEN 'vrijstaand' THEN 1.4 ELSE 1.2 END
     * CASE WHEN flat THEN 0.7 ELSE 1.0 END * 0.5::DOUBLE AS qv FROM l),
 v AS (SELECT *, {mean(ws, 'wt')} AS rw, {' + '.join(o)} AS ot FROM u),
 k AS (SELECT *, CASE WHEN wall IS NULL THEN 0.731 ELSE rw END AS r1, CASE WHEN wall IS NULL THEN 0.731 WHEN ot > 0 THEN {mean(o, 'ot')} ELSE {mean(t, 'tt')} END AS r2 FROM v),
 h AS (SELECT *, wall * ug + win * uw + dr * uu + grb * uv + rf * ud AS h, mass * 1000 / 3600 * gbo AS c,
   win * 0.7::DOUBLE * g * 0.9 * 0.9 * r1 + wall * (0.6 * 0.04) * ug * r2 + dr * (0.6 * 0.04) * uu * r1 + rf * (0.6 * 0.04) * ud AS asol,
   qv * gbo * pow(4.0::DOUBLE / 10.0, 0.67) / 1000.0 / sqrt(8.0::DOUBLE / 1.2) * 1e4 * CASE cls WHEN 1 THEN 0.23 WHEN 2 THEN 0.2877 ELSE 0.331 END AS ainf FROM k),
 z AS (SELECT *, single AND h > 0 AND wall > 0 AS ok FROM h)
SELECT i::VARCHAR AS vbo_id__str, CASE WHEN ok THEN round_even(h * 100, 0) / 100 END AS H__W_K_1,
  CASE WHEN ok THEN round_even(c * 10, 0) / 10 END AS C__Wh_K_1, CASE WHEN ok THEN round_even(c / h * 1000, 0) / 1000 END AS tau__h,
  CASE WHEN ok THEN round_even(asol * 1000, 0) / 1000 END AS Asol__m2, CASE WHEN ok THEN round_even(ainf * 10, 0) / 10 END AS Ainf__cm2 FROM z"""


def _fitting_sql():
    pick = ", ".join(f"CASE WHEN e.H__W_K_1 IS NOT NULL THEN e.{c} ELSE b.{c} END AS {c}"
                     for c in sig.OUTPUT_COLUMNS)
    return (f"WITH e AS ({label_signature_sql(True)}), b AS ({label_signature_sql(False)}) "
            f"SELECT vbo_id__str, {pick} FROM e JOIN b USING (vbo_id__str)")


def signature_nta(spark, d):
    return _sig(spark, d, "nta8800")


def signature_mwa(spark, d):
    return _sig(spark, d, "mwa")


def signature_best(spark, d):
    return _sig(spark, d, "best", references(spark, d))


def signature_label(spark, d):
    return _sig(spark, d, "ep", references(spark, d))


def signature_fitting(spark, d):
    return _sig(spark, d, "passend", references(spark, d))


def signature_table(spark, d):
    t = sig.table(dwellings(spark, d), ("nta8800", "mwa"))
    return t.select("vbo_id__str", "gemeente__cat", "nta8800_H__W_K_1", "mwa_H__W_K_1", "mwa_tau__h")


SIGNATURE_TABLE = f"""WITH n AS ({signature_sql(False)}), m AS ({signature_sql(True)})
SELECT n.vbo_id__str, o_orderpriority AS gemeente__cat, n.H__W_K_1 AS nta8800_H__W_K_1, m.H__W_K_1 AS mwa_H__W_K_1,
  m.tau__h AS mwa_tau__h FROM n JOIN m USING (vbo_id__str) JOIN orders ON o_orderkey = n.vbo_id__str::BIGINT WHERE o_orderkey % 8 <> 0"""


def signature_lookup(spark, d):
    """All dwellings of one postcode and number, which may be several."""
    out = sig.lookup(dwellings(spark, d), "1007 ab", 8, methods=("nta8800",))
    return out.select("vbo_id__str", F.col("nta8800_H__W_K_1").alias("H"))


LOOKUP = f"""WITH n AS ({signature_sql(False)}) SELECT vbo_id__str, H__W_K_1 AS H FROM n
  WHERE vbo_id__str::BIGINT % 500 = 7"""


def as_learned(spark, d):
    out = sig.compute(dwellings(spark, d), "nta8800").withColumn("uhi", F.col("bouwlagen__0") / 10.0)
    out = sig.as_learned(out, indoor=sig.mean_indoor(F.col("energielabel__cat"), "midden"),
                         heat_island="uhi", share=0.5, tau="gemeten", year="bouwjaar__yr")
    return out.select("vbo_id__str", *[F.round(c, 6).alias(c) for c in ("H__W_K_1", "C__Wh_K_1", "tau__h")])


LEARNED = f"""WITH n AS ({signature_sql(False)}), x AS (SELECT vbo_id__str, H__W_K_1 AS h, o_orderkey AS i, o_orderkey % 140 + 60.0::DOUBLE AS ag,
   o_orderkey * 7 % 125 + 1900 AS y FROM n JOIN orders ON o_orderkey = vbo_id__str::BIGINT),
 v AS (SELECT *, h + 1.205 * 1005.0 * (1.10 * least(0.38 + 0.006 * ag, 0.8) * greatest(0.5 * ag, 35.0) * 3.6 / 0.95) / 3600.0 * 0.5 AS hv,
  (CASE i % 5 WHEN 0 THEN 20.7 WHEN 1 THEN 20.7 WHEN 2 THEN 20.7 - 8.3 * 2 / 6 WHEN 3 THEN 12.4 ELSE 18.33 END + 18.33) / 2 AS t,
  CASE WHEN i % 4 > 0 THEN 0.5 * (i % 4) / 10.0 ELSE 0 END AS w,
  CASE WHEN y < 1976 THEN 40.0 WHEN y < 1989 THEN 50.0 WHEN y < 2001 THEN 57.0 ELSE 71.0 END AS tau FROM x),
 z AS (SELECT *, hv * ((t - 6.44 - w) / (20.0 - 6.44)) AS hl FROM v)
SELECT vbo_id__str, round(hl, 6)::DOUBLE AS H__W_K_1, round(tau * hl, 6)::DOUBLE AS C__Wh_K_1, round(tau, 6)::DOUBLE AS tau__h FROM z"""


def publication_plans(spark, d):
    """Rounding plans for the signature of the finished orders, linked by id."""
    pop = Population(sig.population_columns(dwellings(spark, d)))
    ds = table(spark, d, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("record_id"), F.col("o_orderkey").cast("string").alias("bag"))
    raw = pop.df.withColumn("vbo_id__str", F.lpad("vbo_id__str", 16, "0"))
    return publish.explore(ds, Population(raw), "nta8800", {"H": [10.0, 50.0], "C": [1000.0, 10000.0]},
                           Threshold(), vbo_id="bag")


PLANS = f"""WITH n AS (SELECT *, vbo_id__str::BIGINT AS i FROM ({signature_sql(False)})),
 f AS (SELECT n.* FROM n JOIN orders ON o_orderkey = i WHERE o_orderstatus = 'F'),
 g AS (SELECT * FROM (VALUES (10.0, 1000.0), (10.0, 10000.0), (50.0, 1000.0), (50.0, 10000.0)) t(sh, sc)),
 c AS (SELECT DISTINCT sh, sc, floor(H__W_K_1 / sh + 0.5) * sh AS h, floor(C__Wh_K_1 / sc + 0.5) * sc AS c FROM f, g),
 k AS (SELECT sh, sc, h, c.c, (SELECT count(*) FROM n WHERE (c.h IS NULL OR (H__W_K_1 >= c.h - sh / 2 AND H__W_K_1 <= c.h + sh / 2))
   AND (c.c IS NULL OR (C__Wh_K_1 >= c.c - sc / 2 AND C__Wh_K_1 <= c.c + sc / 2))) AS n FROM c),
 s AS (SELECT k.sh, k.sc, n, count(*) AS f FROM f JOIN k ON floor(H__W_K_1 / sh + 0.5) * sh IS NOT DISTINCT FROM k.h
   AND floor(C__Wh_K_1 / sc + 0.5) * sc IS NOT DISTINCT FROM k.c GROUP BY k.sh, k.sc, k.h, k.c, n),
 l AS (SELECT avg(1 / H__W_K_1) AS ih, avg(1 / C__Wh_K_1) AS ic FROM f)
SELECT sh::DOUBLE AS "stap_H", sc::DOUBLE AS "stap_C", sum(CASE WHEN n >= 11 AND f <= n THEN f ELSE 0 END)::BIGINT AS publiceerbaar,
  round(100 * sum(CASE WHEN n >= 11 AND f <= n THEN f ELSE 0 END) / sum(f), 1) AS publiceerbaar_pct,
  (sum(f) - sum(CASE WHEN n >= 11 AND f <= n THEN f ELSE 0 END))::BIGINT AS niet_publiceren,
  (SELECT quantile_cont(q.n, 0.5) FROM (SELECT unnest(range(f)), n FROM s t WHERE t.sh = s.sh AND t.sc = s.sc AND n > 0) q)::DOUBLE AS k_mediaan,
  round((100 * sh / sqrt(12) * max(ih) + 100 * sc / sqrt(12) * max(ic)) / 2, 1)::DOUBLE AS precisieverlies_pct,
  round(100 * sh / sqrt(12) * max(ih), 1)::DOUBLE AS "precisieverlies_H_pct", round(100 * sc / sqrt(12) * max(ic), 1)::DOUBLE AS "precisieverlies_C_pct"
FROM s, l GROUP BY sh, sc"""


# --- hours, sun and wind ----------------------------------------------------------------------------

def hour_values(spark, d):
    """Mean value per hour of all events: the hours of the test month."""
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("time")).agg(
        F.avg("value").alias("x"))


def hourly_means(spark, d):
    e = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("tijd"),
                                         F.format_string("%.2f", "value").alias("waarde"))
    return trace.hourly(e, "user_id", "tijd", "waarde").withColumn("v", F.round("v", 6))


HOURLY = """SELECT user_id AS id, date_trunc('hour', ts) AS time, round(avg(value), 6) AS v FROM events GROUP BY ALL"""


def busiest_hours(spark, d):
    e = table(spark, d, "events")
    return trace.busiest_hours(trace.hourly(e, "user_id", "ts", "value"), 50)


BUSIEST = """SELECT date_trunc('hour', ts) AS time FROM events GROUP BY 1
 ORDER BY count(DISTINCT user_id) DESC, 1 LIMIT 50"""


def sun_on_walls(spark, d):
    h = hour_values(spark, d).select("time", (F.col("x") * 4).alias("ghi"))
    return sig.sector_ratios(h, "time", "ghi").withColumn("verhouding", F.round("verhouding", 9))


_G = "(2 * pi() / 365.0 * (dayofyear(m) - 1 + (hr - 12) / 24))"
SUN = f"""WITH h AS (SELECT date_trunc('hour', ts) AS t, avg(value) * 4 AS ghi FROM events GROUP BY 1),
 a AS (SELECT *, t + INTERVAL 30 MINUTE AS m, hour(t) + 0.5 AS hr FROM h WHERE month(t) IN (10, 11, 12, 1, 2, 3, 4)),
 b AS (SELECT *, {_G} AS g FROM a),
 c AS (SELECT *, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eq,
   0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS dc,
   1361.0 * (1.00011 + 0.034221 * cos(g) + 0.00128 * sin(g) + 0.000719 * cos(2 * g) + 0.000077 * sin(2 * g)) AS i0 FROM b),
 e AS (SELECT *, radians((hr * 60 + eq + 4 * 5.18) / 4 - 180) AS ha, radians(52.10) AS phi FROM c),
 f AS (SELECT *, sin(phi) * sin(dc) + cos(phi) * cos(dc) * cos(ha) AS cz,
   degrees(atan2(sin(ha), cos(ha) * sin(phi) - tan(dc) * cos(phi)) + pi()) AS az FROM e),
 k AS (SELECT *, greatest(cz, 0.065) AS cm, cz > 0.0175 AS up FROM f),
 l AS (SELECT *, CASE WHEN up THEN least(ghi / (i0 * cm), 1.0) ELSE 0 END AS kt FROM k),
 n AS (SELECT *, CASE WHEN NOT up THEN ghi WHEN kt <= 0.22 THEN (1 - 0.09 * kt) * ghi
   WHEN kt <= 0.80 THEN (0.9511 - 0.1604 * kt + 4.388 * kt * kt - 16.638 * pow(kt, 3) + 12.336 * pow(kt, 4)) * ghi ELSE 0.165 * ghi END AS dhi FROM l),
 o AS (SELECT *, CASE WHEN up THEN (ghi - dhi) / cm ELSE 0 END AS dni FROM n),
 s AS (SELECT *, greatest(0, least(1, dni / i0)) AS ai, CASE WHEN up THEN greatest(sqrt(greatest(0, 1 - cz * cz)) * cos(radians(az - sector * 45.0)), 0) ELSE 0 END AS ct
   FROM o, (SELECT range::INTEGER AS sector FROM range(8)))
SELECT sector, round(sum(dni * ct + dhi * (ai * ct / cm + (1 - ai) * 0.5) + ghi * 0.2 * 0.5) / sum(ghi), 9) AS verhouding FROM s GROUP BY sector"""


def wind_constants(spark, d):
    h = hour_values(spark, d).select((F.col("x") % 25 - 3).alias("t"), (F.col("x") % 9).alias("wind"))
    return sig.lbl_constants(h, "t", "wind").withColumn("k", F.round("k", 9))


WIND = """WITH h AS (SELECT avg(value) % 25 - 3 AS t, avg(value) % 9 AS v FROM events GROUP BY date_trunc('hour', ts)),
 c(klasse, cs, cw) AS (VALUES (1, 0.000145::DOUBLE, 0.000319::DOUBLE), (2, 0.000290, 0.000420), (3, 0.000435, 0.000494))
SELECT klasse, round(10.0 * sum(sqrt(cs * (20 - t) + cw * v * v) * (20 - t)) / sum(v * (20 - t)), 9) AS k FROM h, c WHERE t < 20 GROUP BY klasse"""

# --- series with a planted source: every user has the weather of the station of a nation, an hour or
# two shifted; stations are nations ------------------------------------------------------------------


def weather_stations(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        (k + 200).cast("string").alias("station"), (uniform("wla", k) * 2 + 51).alias("lat"),
        (uniform("wlo", k) * 3 + 4).alias("lon"))


def _hours(spark, d):
    """The hours of the test month, as an array for one row per place."""
    a, b = table(spark, d, "events").agg(F.date_trunc("hour", F.min("ts")),
                                         F.date_trunc("hour", F.max("ts"))).first()
    return F.sequence(F.lit(a), F.lit(b), F.expr("interval 1 hour"))


def _signal(nr, h):
    """Temperature of a station: the same formula in both engines, to a tenth."""
    return F.round(8 + 5 * F.sin(h * 0.2618) + uniform("w", nr, h) * 12, 1)


def weather(spark, d):
    """Hourly values per station; some stations lack the second quantity."""
    n = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(n, F.explode(_hours(spark, d)).alias("time"))
    h = (F.unix_timestamp("time") / 3600).cast("bigint")
    return rows.select((n + 200).cast("string").alias("station"), "time", _signal(n, h).alias("T"),
                       F.when(n % 7 != 3, F.lit(100.0)).alias("Q"))


#: Users whose series one task makes: every row becomes a month of hours.
USERS = 2_000


def users(spark, d):
    """The users, in as many parts as their series need."""
    u = cut(table(spark, d, "events").select("user_id").distinct())
    return u.repartition(max(spark.sparkContext.defaultParallelism, -(-u.count() // USERS)), "user_id")


def planted(spark, d):
    """Per user the values of station ``user % 25`` with a shift of ``user % 5 - 2`` hours."""
    u = users(spark, d)
    w = weather(spark, d).select("station", "time", "T")
    s = u.withColumn("station", (F.col("user_id") % 25 + 200).cast("string"))
    t = F.timestamp_seconds(F.unix_timestamp("time") + (F.col("user_id") % 5 - 2) * 3600)
    return s.join(w, "station").select(F.col("user_id").alias("id"), t.alias("time"), F.col("T").alias("v"))


def traced_shifts(spark, d):
    _, shifts = trace.align(planted(spark, d), weather(spark, d))
    return shifts.select("id", "period", "shift", "zomer")


TRACED_SHIFTS = """SELECT DISTINCT user_id AS id, 0 AS period, (2 - user_id % 5)::INTEGER AS shift, FALSE AS zomer FROM events"""


def traced_stations(spark, d):
    a, _ = trace.align(planted(spark, d), weather(spark, d))
    return trace.station_fit(a, weather(spark, d)).select("id", F.col("cand").alias("station"),
                                                          F.round("rms", 6).alias("rms"), "exact")


TRACED_STATIONS = """SELECT DISTINCT user_id AS id, (user_id % 25 + 200)::VARCHAR AS station, 0.0::DOUBLE AS rms, TRUE AS exact FROM events"""


def traced_months(spark, d):
    a, _ = trace.align(planted(spark, d), weather(spark, d))
    return trace.monthly_stations(a, weather(spark, d)).select("id", "maand", "station")


TRACED_MONTHS = """SELECT DISTINCT user_id AS id, date_trunc('month', TIMESTAMP '2024-01-01') AS maand,
  (user_id % 25 + 200)::VARCHAR AS station FROM events"""


def _cells(spark, d, levels=(4, 5)):
    p = geo.with_cells(customers(spark, d), levels)
    return trace.grid_cells(p, levels)


def interpolated(spark, d):
    """Weather at the centres of the coarse cells that hold customers."""
    pts = _cells(spark, d, (4,))
    w = trace.distance_weights(pts, weather_stations(spark, d), 2.0)
    return trace.interpolate(weather(spark, d), w).groupBy("cand").agg(
        F.count(F.lit(1)).alias("uren"), F.round(F.avg("x"), 6).alias("gemiddeld"),
        F.round(F.max("x"), 6).alias("hoogste"))


def _interpolated_sql():
    import math

    from .place_queries import KX, KY, cell_sql
    e = 9.85 * 7.0 ** 0.5
    return f"""WITH {PTS}, cl AS (SELECT DISTINCT {cell_sql('la', 'lo', 4)} AS cand FROM pts),
 p AS (SELECT cand, {e!r}::DOUBLE * split_part(cand, ':', 3)::BIGINT * 1.5 / {KY!r} AS la, {e!r}::DOUBLE * (split_part(cand, ':', 2)::BIGINT
   * {math.sqrt(3.0)!r}::DOUBLE + split_part(cand, ':', 3)::BIGINT * {math.sqrt(3.0) / 2!r}::DOUBLE) / {KX!r} AS lo FROM cl),
 s AS (SELECT n_nationkey AS n, {_u('wla', 'n_nationkey')} * 2 + 51 AS la, {_u('wlo', 'n_nationkey')} * 3 + 4 AS lo FROM nation),
 hh AS (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS t FROM events),
 w AS (SELECT n_nationkey AS n, t, round(8 + 5 * sin(h * 0.2618) + (('0x' || substr(md5('w|' || n_nationkey || '|' || h), 1, 8))::BIGINT
   / 4294967296.0::DOUBLE) * 12, 1) AS v FROM nation, (SELECT t, (epoch(t) / 3600)::BIGINT AS h FROM hh)),
 k AS (SELECT cand, n, 1.0 / pow(greatest({HAVERSINE.replace('6371.0088', '6371.0')}, 0.5), 2) AS w FROM p, s),
 x AS (SELECT cand, t, sum(k.w * v) / sum(k.w) AS x FROM k JOIN w USING (n) GROUP BY ALL)
SELECT cand, count(*) AS uren, round(avg(x), 6) AS gemiddeld, round(max(x), 6) AS hoogste FROM x GROUP BY cand"""


def interpolated_rbf(spark, d):
    pts = _cells(spark, d, (4,))
    x = trace.interpolate_rbf(weather(spark, d), weather_stations(spark, d), pts, "thin_plate")
    return x.groupBy("cand").agg(F.count(F.lit(1)).alias("uren"), F.round(F.avg("x"), 6).alias("gemiddeld"))


def _four(spark, d):
    """All stations in four groups: the middle of a group, and its mean value per hour."""
    g = (F.col("station").cast("int") % 4).cast("string").alias("station")
    st = weather_stations(spark, d).groupBy(g).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return weather(spark, d).groupBy(g, "time").agg(F.avg("T").alias("T")), st


def interpolated_plate(spark, d):
    """A thin plate through four places, at the centres of the coarse cells that hold customers."""
    ref, st = _four(spark, d)
    x = trace.interpolate_rbf(ref, st, _cells(spark, d, (4,)), "thin_plate")
    return x.groupBy("cand").agg(F.count(F.lit(1)).alias("uren"), F.round(F.avg("x"), 3).alias("gemiddeld"),
                                 F.round(F.max("x"), 3).alias("hoogste"))


def _plate_sql():
    """Through four points a plate has one degree of freedom beside its plane: the combination of the
    points that no plane touches, whose weights are signed areas of triangles."""
    import math

    from .place_queries import KX, KY, cell_sql
    e = 9.85 * 7.0 ** 0.5

    def area(i, j, k):
        return f"((x{j} - x{i}) * (y{k} - y{i}) - (x{k} - x{i}) * (y{j} - y{i}))"

    def phi(a, b):
        r = f"(pow({a[0]} - {b[0]}, 2) + pow({a[1]} - {b[1]}, 2))"
        return f"({r} * ln({r} + 1e-300) / 2)"

    at = [(f"x{i}", f"y{i}") for i in range(4)]
    bend = " + ".join(f"m{i} * m{j} * {phi(at[i], at[j])}" for i in range(4) for j in range(4))
    over = [" + ".join(f"m{j} * {phi(at[i], at[j])}" for j in range(4)) for i in range(3)]
    rows = ", ".join(f"max(CASE WHEN g = {i} THEN x END) AS x{i}, max(CASE WHEN g = {i} THEN y END) AS y{i}" for i in range(4))
    values = ", ".join(f"max(CASE WHEN g = {i} THEN v END) AS v{i}" for i in range(4))
    here = " + ".join(f"m{i} * {phi(('px', 'py'), at[i])}" for i in range(4))
    part = [f"(({at[j][0]} - px) * ({at[k][1]} - py) - ({at[k][0]} - px) * ({at[j][1]} - py)) / {area(0, 1, 2)}"
            for j, k in ((1, 2), (2, 0), (0, 1))]   # of each of three points in the plane at p
    return f"""WITH {PTS}, cl AS (SELECT DISTINCT {cell_sql('la', 'lo', 4)} AS cand FROM pts),
 p AS (SELECT cand, {e!r}::DOUBLE * split_part(cand, ':', 3)::BIGINT * 1.5 AS py, {e!r}::DOUBLE * (split_part(cand, ':', 2)::BIGINT
   * {math.sqrt(3.0)!r}::DOUBLE + split_part(cand, ':', 3)::BIGINT * {math.sqrt(3.0) / 2!r}::DOUBLE) AS px FROM cl),
 st AS (SELECT (n_nationkey + 200) % 4 AS g, avg({_u('wlo', 'n_nationkey')} * 3 + 4) * {KX!r} AS x, avg({_u('wla', 'n_nationkey')} * 2 + 51) * {KY!r} AS y FROM nation GROUP BY 1),
 s4 AS (SELECT {rows} FROM st),
 m AS (SELECT *, {area(1, 2, 3)} AS m0, -{area(0, 2, 3)} AS m1, {area(0, 1, 3)} AS m2, -{area(0, 1, 2)} AS m3 FROM s4),
 b AS (SELECT *, {bend} AS bend FROM m),
 hh AS (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS t FROM events),
 w AS (SELECT (n_nationkey + 200) % 4 AS g, h, avg(round(8 + 5 * sin(h * 0.2618) + (('0x' || substr(md5('w|' || n_nationkey || '|' || h), 1, 8))::BIGINT
   / 4294967296.0::DOUBLE) * 12, 1)) AS v FROM nation, (SELECT (epoch(t) / 3600)::BIGINT AS h FROM hh) GROUP BY ALL),
 v AS (SELECT h, {values} FROM w GROUP BY h),
 f AS (SELECT h, b.*, v0, v1, v2, (m0 * v0 + m1 * v1 + m2 * v2 + m3 * v3) / bend AS a FROM v, b),
 r AS (SELECT *, v0 - a * ({over[0]}) AS u0, v1 - a * ({over[1]}) AS u1, v2 - a * ({over[2]}) AS u2 FROM f),
 x AS (SELECT cand, h, a * ({here}) + u0 * {part[0]} + u1 * {part[1]} + u2 * {part[2]} AS x FROM r, p)
SELECT cand, count(*) AS uren, round(avg(x), 3) AS gemiddeld, round(max(x), 3) AS hoogste FROM x GROUP BY cand"""


def border_cells(spark, d):
    return trace.border_cells(_cells(spark, d, (5,)), weather_stations(spark, d))


def traced_series(spark, d):
    """Every series on its own: the station or cell it fits best."""
    s = planted(spark, d)
    return trace.trace(s, weather(spark, d), weather_stations(spark, d), _cells(spark, d)).select(
        "id", "verschuiving_uur", "regime", "locatie", F.round("rms", 6).alias("rms"), "exact", "onzekerheid_km")


TRACED_SERIES = """SELECT DISTINCT user_id AS id, (2 - user_id % 5)::INTEGER AS verschuiving_uur, 'station' AS regime,
  (user_id % 25 + 200)::VARCHAR AS locatie, 0.0::DOUBLE AS rms, TRUE AS exact, 0.0::DOUBLE AS onzekerheid_km FROM events"""


def checked_stations(spark, d):
    """The station of a record against the stations of its region."""
    from ..operators.enrich import nearest

    pop = nearest(customers(spark, d), weather_stations(spark, d), station="station").join(
        table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("regio")), "id")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("record_id"), F.lower("c_mktsegment").alias("regio"),
                                           (F.col("c_custkey") % 30 + 200).cast("string").alias("station"))
    out = trace.check_assignment(c, "station", "regio", pop, pop_region="regio")
    return out.select("record_id", "station_gelezen", "verdacht")


CHECKED = f"""WITH {PTS.replace(' sts AS', ' sts0 AS')}, sts AS (SELECT (n_nationkey + 200)::VARCHAR AS s, {_u('wla', 'n_nationkey')} * 2 + 51 AS la,
   {_u('wlo', 'n_nationkey')} * 3 + 4 AS lo FROM nation),
 n AS (SELECT id, seg, arg_min(s, km) AS st FROM (SELECT id, seg, s.s, {HAVERSINE} AS km FROM pts p, sts s) GROUP BY ALL),
 r AS (SELECT seg, list_sort(list(DISTINCT st)) AS al FROM n GROUP BY seg),
 c AS (SELECT c_custkey, c_mktsegment AS seg, (c_custkey % 30 + 200)::VARCHAR AS s FROM customer)
SELECT c_custkey AS record_id, CASE WHEN list_contains(al, s) THEN s ELSE array_to_string(list_sort(list_append(al, s)), '|') END AS station_gelezen,
  NOT list_contains(al, s) AS verdacht FROM c JOIN r USING (seg)"""

BORDER = f"""WITH {PTS.replace(' sts AS', ' sts0 AS')}, sts AS (SELECT (n_nationkey + 200)::VARCHAR AS s, {_u('wla', 'n_nationkey')} * 2 + 51 AS la,
   {_u('wlo', 'n_nationkey')} * 3 + 4 AS lo FROM nation), cl AS (SELECT DISTINCT CELL AS cand FROM pts),
 p AS (SELECT cand, EDGE * split_part(cand, ':', 3)::BIGINT * 1.5 / KY AS la, EDGE * (split_part(cand, ':', 2)::BIGINT * SQ3
   + split_part(cand, ':', 3)::BIGINT * SQ32) / KX AS lo FROM cl),
 r AS (SELECT cand, s.s FROM p, sts s QUALIFY row_number() OVER (PARTITION BY cand ORDER BY {HAVERSINE}, s.s) <= 2)
SELECT cand, array_to_string(list_sort(list(s)), '|') AS stations FROM r GROUP BY cand"""


def _border_sql():
    import math

    from .place_queries import KX, KY, cell_sql
    out = BORDER.replace("CELL", cell_sql("la", "lo", 5)).replace("EDGE", f"{9.85!r}::DOUBLE")
    return out.replace("SQ32", f"{math.sqrt(3.0) / 2!r}::DOUBLE").replace(
        "SQ3", f"{math.sqrt(3.0)!r}::DOUBLE").replace("KY", repr(KY)).replace("KX", repr(KX))


def sampled_users(spark, d):
    """The events of forty users, chosen by a hash of their id."""
    from ..sources.series import sample_entities

    e = table(spark, d, "events").select("event_id", "user_id", "value")
    return sample_entities(e, 40, 3, "user_id")


SAMPLED = """SELECT event_id, user_id, value FROM events WHERE user_id IN (SELECT user_id FROM (SELECT DISTINCT user_id FROM events)
  ORDER BY md5('3|' || user_id), user_id LIMIT 40)"""


def series_folder(spark, d):
    """The events as folders of files in two layouts, read back by name."""
    from ..session import checkpoint_dir
    from ..sources.series import read_series

    e = table(spark, d, "events")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    when = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("tijdstip")
    e.where("user_id % 2 = 0").select("user_id", when, F.col("value").alias("T_out")).withColumnRenamed(
        "user_id", "home_id").write.option("header", True).csv(f"{folder}/a")
    e.where("user_id % 2 = 1").select(F.col("value").alias("outdoor_temp"), F.lit("a;b").alias("note"),
                                      F.col("user_id").alias("home_id"), when).write.option(
        "header", True).option("sep", ";").csv(f"{folder}/b")
    e.select(F.col("event_id").alias("number")).write.option("header", True).csv(f"{folder}/notes")
    s = read_series(spark, folder)
    return s.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("waarde"), 4).alias("som"),
                               F.min("tijd").alias("eerste"))


SERIES_FOLDER = """SELECT user_id::VARCHAR AS id, count(*) AS n, round(sum(value), 4) AS som,
  strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS eerste FROM events WHERE value IS NOT NULL GROUP BY 1"""


def clock_periods(spark, d):
    """The days of all orders as hours of a reference: clock periods of the country they are in."""
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("time"))
    return trace.periods(o)


CLOCK = """WITH h AS (SELECT DISTINCT o_orderdate AS t FROM orders),
 s AS (SELECT y, (m3 - INTERVAL 1 DAY * (isodow(m3) % 7)) + INTERVAL 1 HOUR AS a, (m9 - INTERVAL 1 DAY * (isodow(m9) % 7)) + INTERVAL 1 HOUR AS b
   FROM (SELECT range AS y, make_timestamp(range, 3, 31, 0, 0, 0) AS m3,
     CASE WHEN range <= 1995 THEN make_timestamp(range, 9, 30, 0, 0, 0) ELSE make_timestamp(range, 10, 31, 0, 0, 0) END AS m9 FROM range(1990, 2010))),
 o AS (SELECT t, t >= a AND t < b AS z FROM h JOIN s ON year(t) = y),
 w AS (SELECT *, coalesce(z <> lag(z) OVER (ORDER BY t), FALSE) AS sw FROM o),
 v AS (SELECT *, sum(sw::INT) OVER (ORDER BY t) AS p, max(CASE WHEN sw THEN t END) OVER (ORDER BY t) AS l,
   min(CASE WHEN sw THEN t END) OVER (ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM w)
SELECT t AS time, p::INTEGER AS period, z AS zomer, coalesce(t - l < INTERVAL 24 HOUR, FALSE) OR coalesce(n - t <= INTERVAL 24 HOUR, FALSE) AS bij_wissel FROM v"""


def time_kinds(spark, d):
    """How the users keep time, from the shifts that fit."""
    _, shifts = trace.align(planted(spark, d), weather(spark, d))
    return trace.time_findings(shifts)


TIME_KINDS = """SELECT CASE WHEN user_id % 5 = 2 THEN 'utc' ELSE 'vast' END AS soort, CASE WHEN user_id % 5 <> 2 THEN (2 - user_id % 5)::INTEGER END AS verschuiving,
  count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2"""


def traced_columns(spark, d):
    """The traced place back onto the users, as columns that enter an assessment."""
    t = trace.trace(planted(spark, d), weather(spark, d), weather_stations(spark, d), _cells(spark, d, (4,)))
    users = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return trace.onto_dataset(users, "user_id", t, weather_stations(spark, d))


TRACED_COLUMNS = """SELECT user_id, count(*) AS n, (user_id % 25 + 200)::VARCHAR AS weer_knmi_station, NULL::VARCHAR AS weerzone_h3,
  0.0::DOUBLE AS onzekerheid_km FROM events GROUP BY user_id"""

QUERIES = {
    "signature_nta8800": (signature_nta, signature_sql(False)),
    "signature_mwa": (signature_mwa, signature_sql(True)),
    "signature_best": (signature_best, label_signature_sql(False)),
    "signature_label": (signature_label, label_signature_sql(True)),
    "signature_fitting": (signature_fitting, _fitting_sql()),
    "signature_table": (signature_table, SIGNATURE_TABLE),
    "signature_lookup": (signature_lookup, LOOKUP),
    "signature_as_learned": (as_learned, LEARNED),
    "publication_plans": (publication_plans, PLANS),
    "hourly_means": (hourly_means, HOURLY),
    "busiest_hours": (busiest_hours, BUSIEST),
    "sun_on_walls": (sun_on_walls, SUN),
    "wind_constants": (wind_constants, WIND),
    "interpolated_cells": (interpolated, _interpolated_sql()),
    "interpolated_rbf": (interpolated_rbf, None),
    "interpolated_plate": (interpolated_plate, _plate_sql()),
    "border_cells": (border_cells, _border_sql()),
    "series_folder": (series_folder, SERIES_FOLDER),
    "clock_periods": (clock_periods, CLOCK),
    "time_kinds": (time_kinds, TIME_KINDS),
    "sampled_users": (sampled_users, SAMPLED),
    "traced_columns": (traced_columns, TRACED_COLUMNS),
    "traced_shifts": (traced_shifts, TRACED_SHIFTS),
    "traced_stations": (traced_stations, TRACED_STATIONS),
    "traced_months": (traced_months, TRACED_MONTHS),
    "traced_series": (traced_series, TRACED_SERIES),
    "checked_stations": (checked_stations, CHECKED),
}
