"""Parsing, rendering, widening and reading of published values."""

import pytest
from pyspark.sql import functions as F

from crowdcover.functions import constraints as con

CASES = [
    ("1974", "1974"), ("1960-1979", "1960-1979"), ("1960..1979", "1960-1979"),
    ("1960 t/m 1979", "1960-1979"), ("1960 tot en met 1979", "1960-1979"),
    ("100 to 200", "100-200"), ("<1945", "<=1944"), ("<=1945", "<=1945"), (">2015", ">=2016"),
    (">= 2015", ">=2015"), ("voor 1945", "<=1944"), ("vóór 1945", "<=1944"),
    ("VÓÓR 1945", "<=1944"), ("vanaf 2000", ">=2000"), ("2015+", ">=2015"),
    ("2015 en later", ">=2015"), ("1960s", "1960-1969"), ("1960's", "1960-1969"),
    ("[1980 - 1999]", "1980-1999"), ("(100 - 149]", "100-149"), ("400=>", ">=400"),
    ("12,5", "12.5"), ("-5", "-5"), ("-5--3", "-5--3"), ("max. 100", "<=100"), ("1e3", "1000"),
    ("onbekend", ""), ("-", ""), ("?", ""), ("", ""), (None, ""), (" N/A ", ""),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(CASES)], "i int, v string")
    return {r.i: r.t for r in df.select("i", con.render(con.parse_numeric(F.col("v"))).alias("t"))
            .collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_numeric_forms(parsed, i):
    assert parsed[i] == CASES[i][1], CASES[i]


def one(spark, value, expr, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("x")).first().x


def test_non_integer_strict_bound(spark):
    assert one(spark, "<4,5", con.render(con.parse_numeric(F.col("v"), integer=False))) == "<=4.5"


def test_general_format(spark):
    for v, t in [(1234567.5, "1.23457e+06"), (0.000012345678, "1.23457e-05"), (0.1, "0.1"),
                 (123456.78, "123457"), (2.50, "2.5"), (999999.7, "1e+06"), (-0.00034, "-0.00034")]:
        got = one(spark, v, con.plain(F.col("v")), "v double")
        assert got == t == f"{v:g}"


@pytest.mark.parametrize("bad", ["abc", "1979-1960", "12 maanden", "1960-"])
def test_bad_value_names_row_and_column(spark, bad):
    df = spark.createDataFrame([(7, bad)], "rid int, v string")
    expr = con.parse_numeric(F.col("v"), on_error=con.unreadable(F.col("rid"), "v", F.col("v")))
    with pytest.raises(Exception, match="row 7, column v"):
        df.select(expr.alias("x")).collect()


def test_categorical(spark):
    for v, want in [("A|B", ["A", "B"]), ("B/A", ["A", "B"]), ("A of B", ["A", "B"]),
                    ("a or b", ["a", "b"]), ("C; C", ["C"]), ("C", ["C"])]:
        assert one(spark, v, con.parse_categorical(F.col("v")))["vals"] == want
    assert one(spark, "onbekend", con.parse_categorical(F.col("v"))) is None
    up = con.parse_categorical(F.col("v"), normalise=lambda s: F.when(s != "x", F.upper(s)))
    assert one(spark, "x|b", up)["vals"] == ["B"]
    assert one(spark, "x", up) is None


def test_hull(spark):
    def hull(*texts):
        df = spark.createDataFrame([(t,) for t in texts], "v string")
        return df.select(con.parse_numeric(F.col("v")).alias("c")).agg(
            con.render(con.hull(F.col("c")))).first()[0]

    assert hull("1960-1970", "1965-1980") == "1960-1980"
    assert hull("<1960", "1965-1980") == "<=1980"
    assert hull("<1960", ">1980") == ""             # open at both ends
    assert hull("1960", "onbekend") == ""


def test_readings(spark):
    def read(v, reading, integer=True):
        c = con.parse_numeric(F.col("v"), integer=integer)
        return one(spark, v, con.render(reading.apply(c, integer=integer)))

    assert read("1965", con.Reading(5)) == "1963-1967"
    assert read("1960", con.Reading(10)) == "1955-1964"
    assert read("1960", con.Reading(10, con.DOWN)) == "1960-1969"
    assert read("1960-1969", con.Reading(5)) == "1958-1971"
    assert read("2.5", con.Reading(0.5), integer=False) == "2.25-2.75"
    shared = frozenset([150.0])
    assert read("100-150", con.Reading(0, boundary=con.UPPER, shared=shared)) == "100-149"
    assert read("150-200", con.Reading(0, boundary=con.LOWER, shared=shared)) == "151-200"
    assert con.Reading.from_config("5 beneden") == con.Reading(5, con.DOWN)
    with pytest.raises(ValueError):
        con.Reading(5, "up")


def test_narrowest(spark):
    df = spark.createDataFrame([("1960-1980", "1970-1990"), ("<1975", "1970-1990"),
                                ("1960-1965", "1970-1990"), (None, "1970")], "a string, b string")
    a, b = con.parse_numeric(F.col("a")), con.parse_numeric(F.col("b"))
    got = [(r[0], r[1]) for r in df.select(con.render(con.narrowest(a, b)),
                                           con.contradicts(a, b)).collect()]
    assert got == [("1970-1980", False), ("1970-1974", False), ("1960-1965", True),
                   ("1970", False)]
