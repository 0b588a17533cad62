"""The test tables in the roles the operators need, as DataFrames and as SQL.

Population: all orders with their customer, nation and region. Dataset: the finished orders, as
they might be published (values written as classes, lists or not at all, by fixed rules on the
order key). Nothing is sampled: every query runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import CATEGORICAL, NUMERIC, Knowledge, Qid, custom
from ..operators.population import Population
from ..session import spread

R = Knowledge.REGISTER


FACTS = ("orders", "lineitem", "events", "customer")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(scan) if name in FACTS else scan


def pop_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    c = table(spark, d, "customer")
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    lab = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority"))
    return (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("yr"),
                    F.month("o_orderdate").alias("mo"), F.col("o_totalprice").alias("price"),
                    lab.alias("lab"), F.col("c_mktsegment").alias("seg"),
                    F.col("n_name").alias("nat"), F.col("r_name").alias("reg"),
                    F.col("o_orderstatus").alias("st"), F.col("o_custkey").alias("cust")))


POP = """pop AS (
  SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS yr,
         CAST(month(o_orderdate) AS INTEGER) AS mo, o_totalprice AS price,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS lab,
         c_mktsegment AS seg, n_name AS nat, r_name AS reg, o_orderstatus AS st, o_custkey AS cust
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def population(spark: SparkSession, d: str) -> Population:
    return Population(pop_rows(spark, d), sources={"orders": "test"})


def dataset(spark: SparkSession, d: str) -> DataFrame:
    """The finished orders as published."""
    p = pop_rows(spark, d).where(F.col("st") == "F")
    i, yr, price = F.col("id"), F.col("yr"), F.col("price")

    def txt(c):
        return c.cast("bigint").cast("string")

    def pick(n, *options):
        out = F.lit(None).cast("string")
        for k, o in enumerate(options):
            out = F.when(i % n == k, o).otherwise(out)
        return out

    b, b2 = F.floor(price / 50000.0), F.floor(price / 100000.0)
    jaar = pick(6, txt(yr), F.concat(txt(yr - 1), F.lit("-"), txt(yr + 1)),
                F.concat(F.lit("<"), txt(yr + 1)), F.concat(F.lit(">="), txt(yr)),
                F.concat(txt(yr), F.lit(" t/m "), txt(yr + 2)), F.lit("onbekend"))
    prijs = pick(4, F.concat(txt(b * 50000), F.lit("-"), txt((b + 1) * 50000)),
                 F.concat(F.lit("<="), txt((b + 1) * 50000)), F.lit(None).cast("string"),
                 F.concat(F.lit("["), txt(b2 * 100000), F.lit(" - "), txt((b2 + 1) * 100000),
                          F.lit("]")))
    lab = F.when(F.col("lab").isNotNull(), pick(
        3, F.col("lab"), F.concat(F.col("lab"), F.lit("|1-URGENT"))))
    return p.select(i.alias("record_id"), jaar.alias("jaar"), prijs.alias("prijs"),
                    lab.alias("label"), pick(2, F.col("seg"), F.lower("seg")).alias("segment"),
                    F.when(i % 5 < 4, F.col("nat")).alias("land"),
                    F.col("mo").cast("string").alias("maand"))


SPECS = {
    "jaar": custom("jaar", NUMERIC, R, population_column="yr"),
    "prijs": custom("prijs", NUMERIC, R, population_column="price", integer=False),
    "label": custom("label", CATEGORICAL, R, population_column="lab"),
    "segment": custom("segment", CATEGORICAL, R, population_column="seg",
                      normalise=lambda s: F.upper(F.trim(s))),
    "land": custom("gemeente", CATEGORICAL, R, population_column="nat"),
    "regio": custom("provincie", CATEGORICAL, R, population_column="reg"),
    "maand": custom("maand", NUMERIC, Knowledge.INSIDER),
}


def qids(*names: str) -> list[Qid]:
    return [Qid(n, SPECS[n]) for n in (names or ("jaar", "prijs", "label", "segment", "land"))]


# what the published texts mean, worked out from the rules and not from the texts
CONS = """cons AS (
  SELECT id, mo,
    CASE id % 6 WHEN 0 THEN yr WHEN 1 THEN yr - 1 WHEN 3 THEN yr WHEN 4 THEN yr END AS ylo,
    CASE id % 6 WHEN 0 THEN yr WHEN 1 THEN yr + 1 WHEN 2 THEN yr WHEN 4 THEN yr + 2 END AS yhi,
    CASE id % 4 WHEN 0 THEN floor(price / 50000.0) * 50000
                WHEN 3 THEN floor(price / 100000.0) * 100000 END AS plo,
    CASE id % 4 WHEN 0 THEN (floor(price / 50000.0) + 1) * 50000
                WHEN 1 THEN (floor(price / 50000.0) + 1) * 50000
                WHEN 3 THEN (floor(price / 100000.0) + 1) * 100000 END AS phi,
    CASE WHEN lab IS NULL OR id % 3 = 2 THEN NULL WHEN id % 3 = 0 OR lab = '1-URGENT' THEN [lab]
         ELSE ['1-URGENT', lab] END AS labs,
    seg, CASE WHEN id % 5 < 4 THEN nat END AS nat
  FROM pop WHERE st = 'F')"""


def match(unknown: bool = False) -> str:
    lab = "p.lab IS NULL OR " if unknown else ""
    return f"""(c.ylo IS NULL OR p.yr >= c.ylo) AND (c.yhi IS NULL OR p.yr <= c.yhi)
      AND (c.plo IS NULL OR p.price >= c.plo) AND (c.phi IS NULL OR p.price <= c.phi)
      AND (c.labs IS NULL OR {lab}list_contains(c.labs, p.lab)) AND p.seg = c.seg
      AND (c.nat IS NULL OR p.nat = c.nat)"""


def risk(*, unknown: bool = False, scope: str = "TRUE", share: str = "1.0", k: int = 11,
         cons: str = CONS, extra: str = "") -> str:
    """SQL for the risk of every record of the dataset, brute force over the classes: ends in a
    table ``res``."""
    return f"""WITH {POP}, {cons}{extra},
 classes AS (SELECT ylo, yhi, plo, phi, labs, seg, nat, count(*) AS f, min(id) AS klasse
             FROM cons GROUP BY ALL),
 counts AS (SELECT c.klasse, count(p.id) AS n FROM classes c
            JOIN (SELECT * FROM pop WHERE {scope}) p ON {match(unknown)} GROUP BY c.klasse),
 rec AS (SELECT s.id, s.mo, c.klasse, c.f, coalesce(n, 0) AS big_f FROM cons s
   JOIN classes c ON s.ylo IS NOT DISTINCT FROM c.ylo AND s.yhi IS NOT DISTINCT FROM c.yhi
    AND s.plo IS NOT DISTINCT FROM c.plo AND s.phi IS NOT DISTINCT FROM c.phi
    AND s.labs IS NOT DISTINCT FROM c.labs AND s.seg = c.seg
    AND s.nat IS NOT DISTINCT FROM c.nat LEFT JOIN counts USING (klasse)),
 kk AS (SELECT *, big_f * {share} AS k,
               CASE WHEN big_f > 0 THEN f / big_f ELSE 'infinity'::DOUBLE END AS delta FROM rec),
 res AS (SELECT *, CASE WHEN k > 0 THEN least(1.0 / k, 1.0) ELSE 1.0 END AS risico,
   CASE WHEN big_f = 0 THEN 'geen_match' WHEN k < {k} OR f > big_f THEN 'risico' ELSE 'ok' END
     AS status,
   CASE WHEN big_f = 0 THEN 'no population row matches this record' ELSE concat_ws('; ',
     CASE WHEN k < {k} THEN 'k=' || format('{{:.3g}}', k) || ' < {k}' END,
     CASE WHEN f > big_f THEN 'more records than population rows in this class' END) END
     AS redenen FROM kk)"""
