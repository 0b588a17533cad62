"""Writing results. Tables are written by Spark as they are, in parallel; nothing is gathered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import Qid
from ..functions.numbers import three_digits
from ..operators.assess import summary
from ..operators.report import per_record, publishable


def write_assessment(assessed: DataFrame, qids: Sequence[Qid], path: str, *,
                     drop: Sequence[str] = (), record: str = "record_id") -> None:
    """What may be published, the internal report per record, and the summary, apart."""
    publishable(assessed, drop).write.mode("overwrite").option("header", True).csv(
        f"{path}/publiceerbaar")
    per_record(assessed, qids, record).write.mode("overwrite").parquet(f"{path}/per_record")
    summary(assessed).write.mode("overwrite").json(f"{path}/samenvatting")


def write_rainbow(table: DataFrame, metadata: DataFrame, path: str) -> None:
    """A frequency table with its scheme next to it."""
    table.write.mode("overwrite").parquet(f"{path}/tabel")
    metadata.write.mode("overwrite").json(f"{path}/schema")


def write_candidates(candidates: DataFrame, path: str) -> None:
    """Candidate lists point at people: kept apart from everything that is published."""
    candidates.write.mode("overwrite").parquet(f"{path}/kandidaten_NIET_PUBLICEREN")


# The columns of a population extract for publication and where they come from.
EXTRACT = {
    "vbo_id__str": "BAG", "postcode6__str": "BAG", "huisnummer__str": "BAG",
    "huisletter__str": "BAG", "toevoeging__str": "BAG", "woonplaats__cat": "BAG",
    "gemeente__cat": "CBS", "provincie__cat": "CBS", "bouwjaar__yr": "BAG",
    "oppervlakte__m2": "BAG", "pand_woningen__0": "BAG", "lat__degN": "BAG", "lon__degE": "BAG",
    "uhi__degC": "RIVM", "daktype__cat": "3D-BAG", "bouwlagen__0": "3D-BAG", "hoogte__m": "3D-BAG",
    "aaneengebouwd__bool": "3D-BAG", "opp_grond__m2": "3D-BAG", "opp_dak_plat__m2": "3D-BAG",
    "opp_dak_schuin__m2": "3D-BAG", "opp_buitenmuur__m2": "3D-BAG",
    "opp_scheidingsmuur__m2": "3D-BAG", "buren__0": "BAG", "blok_panden__0": "BAG",
}


def extract(population: DataFrame, columns: Sequence[str] = tuple(EXTRACT), *,
            rounded: Sequence[str] = (), position_digits: int = 5) -> DataFrame:
    """The columns of a population that may be published: positions to five decimals, computed
    numbers to three significant digits."""
    out = []
    for c in columns:
        if c not in population.columns:
            continue
        if c in ("lat__degN", "lon__degE"):
            out.append(F.round(c, position_digits).alias(c))
        else:
            out.append(three_digits(F.col(c)).alias(c) if c in rounded else F.col(c))
    return population.select(*out)


def sources_of(spark, columns: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(c, EXTRACT.get(c, "computed")) for c in columns],
                                 "kolom string, bron string")
