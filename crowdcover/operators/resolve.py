"""Attributes whose population column depends on the data: grid cells and stopped stations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import Qid, cell_column
from ..functions import cleaning as clean
from ..functions import geo
from .population import Population

CELL, STATION = "h3_cel", "knmi_station"


def cell_levels(df: DataFrame, column: str, record: str) -> list[tuple[int, int, int]]:
    """The levels of the cells in a column, that of the first record first: (level, records,
    lowest record)."""
    cell = F.explode(F.split(F.col(column).cast("string"), r"\s*\|\s*"))
    found = df.select(F.col(record).alias("_rid"), cell.alias("c")).where(
        F.col("c").rlike(r"^\s*\d+:-?\d+:-?\d+\s*$"))
    per = found.groupBy(geo.cell_level(F.trim("c")).alias("level")).agg(
        F.countDistinct("_rid").alias("n"), F.min("_rid").alias("first"))
    return sorted(((r["level"], r["n"], r["first"]) for r in per.collect()),   # one per level
                  key=lambda x: (x[2], x[0]))


def resolve(df: DataFrame, qids: Sequence[Qid], population: Population, record: str
            ) -> tuple[list[Qid], list[str]]:
    """The attributes as they can be counted, and notes on what was decided.

    A cell is counted against the population column of its own level; a column without any cell
    constrains nothing, so any level will do, and without levels it is left out. A stopped
    station counts as its successor, unless the population still assigns rows to it."""
    out, notes = [], []
    for q in qids:
        column = q.spec.population_column
        if q.spec.key == CELL and column is not None and column not in population.columns:
            q = _cells(df, q, population, record, notes)
        elif q.spec.key == STATION and column in population.columns:
            q = _station(df, q, population, notes)
        if q is not None:
            out.append(q)
    return out, notes


def _cells(df, q, population, record, notes) -> Qid | None:
    levels = cell_levels(df, q.column, record)
    if levels:
        if len(levels) > 1:
            notes.append(f"{q.column}: cells of levels " + ", ".join(
                f"{lv} ({n} records)" for lv, n, _ in sorted(levels))
                + f"; counted at level {levels[0][0]}")
        return q.with_(spec=replace(q.spec, population_column=cell_column(levels[0][0])))
    have = sorted(c for c in population.columns if c.startswith("h3_r"))
    return q.with_(spec=replace(q.spec, population_column=have[0])) if have else None


def _station(df, q, population, notes) -> Qid:
    old = sorted(clean.SUCCESSORS)
    known = {r[0] for r in population.df.select(
        F.col(q.spec.population_column).cast("string").alias("s")).where(
            F.col("s").isin(*old)).distinct().collect()}
    value = F.explode(F.transform(F.split(F.col(q.column).cast("string"), r"\|"),
                                  clean.station_as_is))
    seen = {r[0] for r in df.select(value.alias("s")).where(F.col("s").isin(*old)).distinct().collect()}
    for s in sorted(seen):
        kept = "itself: the population still has it" if known else f"{clean.SUCCESSORS[s]}, its successor"
        notes.append(f"{q.column}: station {s} has stopped; counted as {kept}")
    return q.with_(spec=replace(q.spec, normalise=clean.station_as_is)) if known else q
