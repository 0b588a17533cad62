"""Time series as datasets ship them: one long table, or a folder with a file per entity."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .datasets import SEPARATORS

# Words in the names of time, value and id columns, and ids in file names.
TIME_HINT = r"tijd|time|timestamp|datum|date|datetime|moment"
VALUE_HINT = (r"buiten_?temp|outdoor_?temp|temp_?buiten|temp_?out|(^|_)t_?(out|outdoor|buiten|"
              r"ambient|amb)(_|$)|^t$|knmi_?t|temperature_?out")
ID_HINT = r"home_?id|woning_?id|location_?id|participant_?id|customer_?id|pseudon|(^|_)id(_|$)"
NAME_ID = r"(?:home_?id=|customer_|woning_?|home_?)?([A-Za-z0-9][A-Za-z0-9-]*?)(?:\.[A-Za-z0-9]+)*$"


def guess(columns, pattern: str) -> str | None:
    return next((c for c in columns if re.search(pattern, str(c), re.I)), None)


def read_series(spark: SparkSession, path: str, *, id_from: str = "kolom", id_col: str | None = None,
                time_col: str | None = None, value_col: str | None = None,
                id_regex: str = NAME_ID, file_format: str = "csv") -> DataFrame:
    """``(id, tijd, waarde)`` with the numeric values that are there. The id comes from a column,
    from the file name (``bestand``) or from the folder name (``map``). Files are read by name, each
    by its own header: their columns may differ in order and number, and files without the columns
    (notes beside the data) are left out."""
    wanted = {"tijd": (time_col, TIME_HINT), "waarde": (value_col, VALUE_HINT)}
    if id_from == "kolom":
        wanted["id"] = (id_col, ID_HINT)
    if file_format == "parquet":
        df = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(path)
        chosen = {k: name if name in df.columns else None if name else guess(df.columns, hint)
                  for k, (name, hint) in wanted.items()}
        if None in chosen.values():
            raise ValueError("no id, time and value column found; name them")
        rows = df.select(*[F.col(c).alias(k) for k, c in chosen.items()], _file().alias("_file"))
    else:
        rows = _csv_rows(spark, path, wanted)
    if id_from != "kolom":
        target = F.element_at(F.split("_file", "/"), -1 if id_from == "bestand" else -2)
        rows = rows.withColumn("id", F.nullif(F.regexp_extract(F.url_decode(target), id_regex, 1), F.lit("")))
    out = rows.select(F.col("id").cast("string").alias("id"), "tijd",
                      F.col("waarde").cast("string").try_cast("double").alias("waarde"))
    return out.where("id is not null and waarde is not null")


def _file() -> Column:
    return F.col("_metadata.file_path")


def headers(lines: DataFrame, wanted: dict[str, tuple[str | None, str]]) -> DataFrame:
    """``(_file, _kop, _sep, _n, tijd, waarde, ...)``: the first line of every file, its separator, the number of
    its columns and the place of each wanted one (named, or the first whose name fits a pattern); files
    that lack one are left out."""
    first = lines.groupBy("_file").agg(F.min_by("value", F.struct("_van", "_nr")).alias("_kop"))
    # the separator that occurs most; of equals the first
    count = {c: F.length("_kop") - F.length(F.replace("_kop", F.lit(c))) for c in SEPARATORS}
    most = F.greatest(*count.values())
    sep = F.coalesce(*[F.when(n == most, F.lit(c)) for c, n in count.items()])
    first = first.withColumn("_sep", sep).withColumn("_namen", F.transform(
        F.split(F.regexp_replace("_kop", "^\ufeff", ""), F.concat(F.lit("\\Q"), "_sep", F.lit("\\E"))),
        lambda c: F.regexp_replace(F.trim(c), '^"|"$', "")))

    def place(name: str | None, hint: str) -> Column:
        fits = F.transform("_namen", lambda c: c == name if name else F.lower(c).rlike(hint))
        return F.array_position(fits, F.lit(True)) - 1

    out = first.withColumn("_n", F.size("_namen")).withColumns({k: place(*v) for k, v in wanted.items()})
    return out.where(" AND ".join(f"{k} >= 0" for k in wanted)).drop("_namen")


def _csv_rows(spark: SparkSession, path: str, wanted: dict[str, tuple[str | None, str]]) -> DataFrame:
    """The wanted columns of all files, each read by its own first line."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", _file().alias("_file"), F.col("_metadata.file_block_start").alias("_van"),
        F.monotonically_increasing_id().alias("_nr"))
    found = cut(headers(lines, wanted))
    size = found.agg(F.max("_n")).first()[0]
    if size is None:
        raise ValueError("no id, time and value column found; name them")
    schema = ", ".join(f"c{i} string" for i in range(size))
    data = lines.select("value", "_file").join(found, "_file").where(
        (F.col("value") != F.col("_kop")) & (F.trim("value") != ""))
    fields = F.coalesce(*[F.when(F.col("_sep") == c, F.array(*[F.from_csv("value", schema, {"sep": c})[f"c{i}"]
                                                             for i in range(size)])) for c in SEPARATORS])
    data = data.withColumn("_v", fields)
    return data.select(*[F.get("_v", F.col(k).cast("int")).alias(k) for k in wanted], "_file")


def sample_entities(series: DataFrame, n: int, seed: int = 0, id_col: str = "id") -> DataFrame:
    """All rows of ``n`` entities, chosen by a hash of their id: the same ones in every run."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    ids = series.select(id_col).distinct().orderBy(order, id_col).limit(n)
    return series.join(ids, id_col, "left_semi")
