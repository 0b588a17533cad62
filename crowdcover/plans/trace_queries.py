"""Tracing whole datasets: series planted in every way they can be derived, and SQL that compares all
candidates hour by hour.

The SQL knows nothing of bounds or buckets: every shift, station, cell and point meets every hour.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.numbers import uniform
from ..operators import trace
from .place_queries import HAVERSINE, KX, KY, PTS, _u, cell_sql, customers
from .signal_queries import _cells, users, weather_stations
from .views import table

#: How far own points are sought.
SEARCH_KM = 3.0
STEPS = math.ceil(SEARCH_KM / (1.5 * geo.edge_km(8)))
#: Days that are added to the test month where a change of station is planted.
MORE_DAYS = 29
_H = "interval 1 hour"


def _methods(kind):
    """Methods that are tried, each with all stations and with those of the second quantity."""
    return ("idw1", "idw2") if kind == "grid" else ("idw2",)


def _weather(spark, d, days=0):
    a, b = table(spark, d, "events").agg(F.date_trunc("hour", F.min("ts")), F.date_trunc("hour", F.max("ts"))).first()
    hours = F.sequence(F.lit(a), F.lit(b) + F.expr(f"interval {days} days"), F.expr(_H))
    n, h = F.col("n_nationkey"), (F.unix_timestamp("time") / 3600).cast("bigint")
    return table(spark, d, "nation").select(n, F.explode(hours).alias("time")).select(
        (n + 200).cast("string").alias("station"), "time",
        F.round(8 + 5 * F.sin(h * 0.2618) + uniform("w", n, h) * 12, 1).alias("T"), F.when(n % 7 != 3, 100.0).alias("Q"))


def _numbered(cells):
    """The cells in order of name, from 0: users are dealt over them."""
    every = cells.select(F.array_sort(F.collect_set("cand")).alias("c"))
    return every.select(F.posexplode("c").alias("k", "cand"), F.size("c").alias("n"))


def _planted(spark, d, kind, ref):
    """Per user a series: that of a station, of a change of stations, interpolated at the centre of a cell or
    at a point near one, or numbers that come from nowhere. Every tenth user has 150 hours only."""
    u = users(spark, d).select(F.col("user_id").alias("id"))
    st = weather_stations(spark, d)
    i, h = F.col("id"), (F.unix_timestamp("time") / 3600).cast("bigint")
    if kind in ("station", "border"):
        feb = F.month("time") > 1
        other = (i % 2 == 0) & feb if kind == "border" else F.lit(False)
        code = (F.when(other, (i + 7) % 25).otherwise(i % 25) + 200).cast("string")
        s = ref.join(u.withColumn("_n", (i % 25 + 200).cast("string")).withColumn(
            "_m", ((i + 7) % 25 + 200).cast("string")), (F.col("station") == F.col("_n")) | (F.col("station") == F.col("_m")))
        s = s.where(F.col("station") == code).select("id", "time", F.col("T").alias("v"))
    elif kind == "nothing":
        s = u.join(ref.select("time").distinct(), F.lit(True)).select("id", "time", (
            uniform("none", i, h) * 30).alias("v"))
    else:
        cells = _numbered(_cells(spark, d, (4,)))
        home = u.join(cells, (i % F.col("n")) == F.col("k")).select("id", "cand")
        if kind == "point":
            at = geo.cell_centre(F.col("cand"))
            fine = geo.parts(geo.cell(at["lat"], at["lon"], 8))
            home = home.select("id", F.concat_ws(":", F.lit("8"), (fine[1] + i % 3 - 1).cast("string"),
                                                 (fine[2] + 1).cast("string")).alias("cand"))
        x = trace.point_series("idw2+Q" if kind == "second" else "idw2", ref, st,
                               trace.with_position(home.select("cand").distinct()))
        s = home.join(x, "cand").select("id", "time", F.col("x").alias("v"))
    s = s.withColumn("time", F.timestamp_seconds(F.unix_timestamp("time") + (i % 5 - 2) * 3600))
    first = F.unix_timestamp(F.lit(ref.agg(F.min("time")).first()[0]))
    return s.where((i % 10 != 9) | (F.unix_timestamp("time") < first + 150 * 3600))


def _found(spark, d, kind):
    ref = _weather(spark, d, MORE_DAYS if kind == "border" else 0)
    return trace.investigate(_planted(spark, d, kind, ref), ref, weather_stations(spark, d), _cells(spark, d, (4,)),
                             methods=_methods(kind), search_km=SEARCH_KM)


def investigated(spark, d, kind):
    """Where every entity is, by the hypothesis that explains the dataset."""
    f = _found(spark, d, kind)
    certain = F.when(F.col("rms") >= 1e-6, F.round("zekerheid", 4))
    return f.per_entity.select("id", "regime", "locatie", F.round("rms", 6).alias("rms"),
                               F.round("rms_2e", 6).alias("rms_2e"), certain.alias("zekerheid"), "exact",
                               "onzekerheid_km", F.lit(f.choice).alias("uitkomst"))


def hypotheses(spark, d, kind):
    """All hypotheses in order."""
    return _found(spark, d, kind).hypotheses.select(
        "rang", "hypothese", "methode", "niveau", "verklaard", "getoetst", F.round("rms_mediaan", 6).alias("rms_mediaan"))


# --- the same in SQL ------------------------------------------------------------------------------

_SPHERE = HAVERSINE.replace("6371.0088", "6371.0")
_E4, _E8 = (9.85 * 7.0 ** ((5 - lv) / 2) for lv in (4, 8))


def _centre(e, c="cand"):
    q, r = (f"split_part({c}, ':', {k})::BIGINT" for k in (2, 3))
    return (f"{e!r}::DOUBLE * {r} * 1.5 / {KY!r} AS la, {e!r}::DOUBLE * ({q} * {math.sqrt(3.0)!r}::DOUBLE + {r} * "
            f"{math.sqrt(3.0) / 2!r}::DOUBLE) / {KX!r} AS lo")


def _at(points, methode, power, second):
    """(methode, cand, h, x) of weights over distance to a power."""
    return f"""SELECT '{methode}' AS methode, cand, h, sum(v / pow(km, {power})) / sum(1.0 / pow(km, {power})) AS x
  FROM (SELECT p.cand, s.n, greatest({_SPHERE}, 0.5) AS km FROM {points} p, st s) k JOIN w USING (n) {'WHERE q' if second else ''} GROUP BY ALL"""


def _best(scored, keys):
    """The nearest of the candidates of ``keys`` in (keys, cand, d, uren), without the largest 2%."""
    return f"""SELECT {keys}, cand, rms, lead(rms) OVER o AS rms_2e, aandeel >= 0.95 AS exact FROM (
  SELECT {keys}, cand, avg((d <= 0.06)::INT) AS aandeel, sqrt(avg(d * d) FILTER (nr <= greatest(floor(uren * 0.98), 1))) AS rms
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, cand ORDER BY d) AS nr FROM {scored}) GROUP BY ALL)
  WINDOW o AS (PARTITION BY {keys} ORDER BY rms, cand) QUALIFY row_number() OVER o = 1"""


def _home(kind):
    i = "id"
    if kind in ("station", "border"):
        n = f"CASE WHEN {i} % 2 = 0 AND month(make_timestamp(h * 3600000000)) > 1 THEN ({i} + 7) % 25 ELSE {i} % 25 END"
        return f"SELECT id, h, v FROM u JOIN w ON n = {n if kind == 'border' else f'{i} % 25'}"
    if kind == "nothing":
        tag = "'none|' || id || '|' || h"
        return f"SELECT id, h, ('0x' || substr(md5({tag}), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 30 AS v FROM u, hh"
    if kind == "point":
        return "SELECT id, h, x AS v FROM homes JOIN hx USING (cand)"
    return f"SELECT id, h, x AS v FROM homes JOIN cx USING (cand) WHERE methode = '{'idw2+Q' if kind == 'second' else 'idw2'}'"


def _dataset_sql(kind):
    """Series, their alignment, and the nearest candidate under every hypothesis."""
    days = MORE_DAYS if kind == "border" else 0
    cells = " UNION ALL ".join(_at("p", m + s, m[-1], s) for m in _methods(kind) for s in ("", "+Q"))
    homes = "SELECT id, cand FROM u JOIN nr ON id % (SELECT count(*) FROM nr) = k"
    if kind == "point":
        fine = cell_sql("la", "lo", 8)
        homes = f"""SELECT id, '8:' || (split_part(f, ':', 2)::BIGINT + id % 3 - 1) || ':' || (split_part(f, ':', 3)::BIGINT + 1) AS cand
  FROM u JOIN (SELECT k, {fine} AS f FROM nr JOIN p USING (cand)) ON id % (SELECT count(*) FROM nr) = k"""
    return f"""WITH {PTS.replace(' sts AS', ' sts0 AS')}, cl AS (SELECT DISTINCT {cell_sql('la', 'lo', 4)} AS cand FROM pts),
 nr AS (SELECT cand, row_number() OVER (ORDER BY cand) - 1 AS k FROM cl), p AS (SELECT cand, {_centre(_E4)} FROM cl),
 st AS (SELECT n_nationkey AS n, {_u('wla', 'n_nationkey')} * 2 + 51 AS la, {_u('wlo', 'n_nationkey')} * 3 + 4 AS lo FROM nation),
 hh AS (SELECT unnest(range((epoch(date_trunc('hour', min(ts))) / 3600)::BIGINT, (epoch(date_trunc('hour', max(ts))) / 3600)::BIGINT + {24 * days} + 1)) AS h FROM events),
 w AS MATERIALIZED (SELECT n_nationkey AS n, h, n_nationkey % 7 <> 3 AS q, round(8 + 5 * sin(h * 0.2618) + (('0x' || substr(md5('w|' || n_nationkey || '|' || h), 1, 8))::BIGINT
   / 4294967296.0::DOUBLE) * 12, 1) AS v FROM nation, hh),
 u AS (SELECT DISTINCT user_id AS id FROM events), homes AS ({homes}), cx AS MATERIALIZED ({cells}),
 hp AS (SELECT DISTINCT cand, {_centre(_E8)} FROM homes), hx AS ({_at('hp', 'idw2', 2, False)}),
 s AS MATERIALIZED (SELECT id, h + id % 5 - 2 AS h, v FROM ({_home(kind)}) WHERE id % 10 <> 9 OR h + id % 5 - 2 < (SELECT min(h) FROM hh) + 150),
 moved AS MATERIALIZED (SELECT id, sh, s.h + sh AS h, s.v, count(*) OVER (PARTITION BY id, sh) AS uren
   FROM s, (VALUES (0, 1), (-1, 2), (1, 3), (-2, 4), (2, 5)) t(sh, r) WHERE s.h + sh IN (SELECT h FROM hh)),
 shifts AS (SELECT id, arg_min(sh, rms * 1e6 + (CASE sh WHEN 0 THEN 1 WHEN -1 THEN 2 WHEN 1 THEN 3 WHEN -2 THEN 4 ELSE 5 END) * 1e-9) AS sh
   FROM ({_best("(SELECT id, sh, n AS cand, abs(m.v - w.v) AS d, uren FROM moved m JOIN w USING (h) WHERE uren >= 24)", "id, sh")}) GROUP BY id),
 al AS MATERIALIZED (SELECT id, h, v, uren FROM moved JOIN shifts USING (id, sh) WHERE uren >= 200),
 cands AS (SELECT 'station' AS hypothese, '-' AS methode, NULL::INT AS niveau, (n + 200)::VARCHAR AS cand, h, v AS x FROM w
   UNION ALL SELECT 'cel', methode, 4, cand, h, x FROM cx),
 fit0 AS MATERIALIZED ({_best("(SELECT id, hypothese, methode, niveau, cand, abs(v - x) AS d, uren FROM al JOIN cands USING (h))", "id, hypothese, methode, niveau")}),
 months AS (SELECT id, count(*) AS m FROM (SELECT id, mo, n, avg((d <= 0.06)::INT) AS a, max(c) AS c FROM (
   SELECT id, month(make_timestamp(al.h * 3600000000)) AS mo, w.n, abs(al.v - w.v) AS d, count(*) OVER (PARTITION BY id, mo, w.n) AS c
   FROM al JOIN w USING (h)) GROUP BY ALL) WHERE a >= 0.95 AND c >= 100 GROUP BY id),
 fit AS (SELECT fit0.* EXCLUDE (exact), exact OR (hypothese = 'station' AND coalesce(m, 0) >= 2) AS exact FROM fit0 LEFT JOIN months USING (id)),
 hyp0 AS (SELECT hypothese, methode, niveau, count(*) FILTER (exact) AS verklaard, count(*) AS getoetst, quantile_cont(rms, 0.5) AS rms_mediaan
   FROM fit GROUP BY ALL)"""


_ORDER = """row_number() OVER (ORDER BY hypothese = 'punt', verklaard / getoetst DESC, hypothese <> 'station', niveau, rms_mediaan, methode)::INT AS rang"""


def hypotheses_sql(kind):
    return f"""{_points_sql(kind)}, hyp AS (SELECT * FROM hyp0 UNION ALL
   SELECT 'punt', (SELECT methode FROM m), 8, count(*) FILTER (exact), count(*), quantile_cont(rms, 0.5) FROM own)
SELECT {_ORDER}, hypothese, methode, niveau, verklaard, getoetst, round(rms_mediaan, 6) AS rms_mediaan FROM hyp"""


def _points_sql(kind):
    """With the fine points around the cells of the nearest method tried as well."""
    c8, k = cell_sql("la", "lo", 8), STEPS
    points = " UNION ALL ".join(_at("fp", m + s, m[-1], s) for m in _methods(kind) for s in ("", "+Q"))
    return f"""{_dataset_sql(kind)},
 m AS (SELECT arg_min(methode, rms_mediaan) AS methode FROM hyp0 WHERE hypothese = 'cel'),
 c8 AS (SELECT cand AS start, split_part(f, ':', 2)::BIGINT AS q, split_part(f, ':', 3)::BIGINT AS r FROM (SELECT cand, {c8} AS f FROM p)),
 near AS (SELECT start, '8:' || (q + a) || ':' || (r + b) AS cand FROM c8, range({-k}, {k + 1}) x(a), range({-k}, {k + 1}) y(b) WHERE abs(a + b) <= {k}),
 fp AS (SELECT DISTINCT cand, {_centre(_E8)} FROM near),
 px AS MATERIALIZED (SELECT * FROM ({points}) WHERE methode = (SELECT methode FROM m)),
 own AS MATERIALIZED ({_best("(SELECT id, near.cand, abs(al.v - px.x) AS d, uren FROM (SELECT id, cand AS start FROM fit JOIN m USING (methode)) f JOIN near USING (start) JOIN al USING (id) JOIN px ON px.h = al.h AND px.cand = near.cand)", "id")})"""


_COLUMNS = "round(rms, 6) AS rms, round(rms_2e, 6) AS rms_2e, CASE WHEN rms >= 1e-6 THEN round(rms_2e / rms, 4) END AS zekerheid"
_TOO_SHORT = f"'{trace.TOO_SHORT}'"


def _rows_sql(kind, base, choice):
    """Every user with what ``base`` (id, regime, locatie, rms, rms_2e, exact, onzekerheid_km) says."""
    return f"""{base} SELECT id, coalesce(regime, {_TOO_SHORT}) AS regime, locatie, {_COLUMNS}, exact, onzekerheid_km, '{choice}' AS uitkomst
FROM u LEFT JOIN per USING (id)"""


def _station_sql(kind):
    base = _dataset_sql(kind)
    border = "NULL::VARCHAR AS strook FROM u"
    if kind == "border":
        border = f"""(SELECT array_to_string(list_sort(list(cand)), '|') FROM (SELECT cand, list_sort(list(n)) AS two FROM (
   SELECT p.cand, s.n FROM p, st s QUALIFY row_number() OVER (PARTITION BY p.cand ORDER BY {_SPHERE}, s.n) <= 2) GROUP BY cand)
   WHERE two = list_sort([id % 25, (id + 7) % 25]) AND id % 2 = 0 AND m = 2) AS strook FROM u LEFT JOIN months USING (id)"""
    return _rows_sql(kind, f"""{base}, strips AS (SELECT id, {border}),
 per AS (SELECT id, CASE WHEN strook IS NULL THEN 'station' ELSE 'grensstrook' END AS regime, coalesce(strook, cand) AS locatie, rms, rms_2e, exact,
   CASE WHEN exact THEN 0.0 ELSE 15.0 END::DOUBLE AS onzekerheid_km FROM fit JOIN strips USING (id) WHERE hypothese = 'station')""", "station")


def _grid_sql(kind):
    return _rows_sql(kind, f"""{_points_sql(kind)}, top AS (SELECT methode FROM (SELECT *, {_ORDER} FROM hyp0) WHERE rang = 1 AND hypothese = 'cel' AND 2 * verklaard >= getoetst),
 per AS (SELECT id, 'h3_r4' AS regime, cand AS locatie, rms, rms_2e, exact, CASE WHEN exact THEN 0.0 ELSE 15.0 END::DOUBLE AS onzekerheid_km
   FROM fit JOIN top USING (methode))""", "grid")


def _own_sql(kind):
    area = cell_sql("la", "lo", 5)
    return _rows_sql(kind, f"""{_points_sql(kind)}, per AS (SELECT id, CASE WHEN exact THEN 'punt' ELSE 'omgeving' END AS regime, CASE WHEN exact THEN cand ELSE a END AS locatie,
   rms, rms_2e, exact, CASE WHEN exact THEN 0.5 ELSE 15.0 END::DOUBLE AS onzekerheid_km FROM own JOIN (SELECT cand, {area} AS a FROM fp) USING (cand))""", "own")


def _none_sql(kind):
    area = cell_sql("la", "lo", 5)
    return _rows_sql(kind, f"""{_points_sql(kind)}, per AS (SELECT id, 'omgeving' AS regime, a AS locatie, rms, rms_2e, FALSE AS exact, 15.0::DOUBLE AS onzekerheid_km
   FROM own JOIN (SELECT cand, {area} AS a FROM fp) USING (cand))""", "none")


QUERIES = {
    "investigated_series": (partial(investigated, kind="station"), _station_sql("station")),
    "investigated_border": (partial(investigated, kind="border"), _station_sql("border")),
    "investigated_grid": (partial(investigated, kind="grid"), _grid_sql("grid")),
    "investigated_points": (partial(investigated, kind="point"), _own_sql("point")),
    "investigated_nothing": (partial(investigated, kind="nothing"), _none_sql("nothing")),
    "hypotheses_second": (partial(hypotheses, kind="second"), hypotheses_sql("second")),
}
