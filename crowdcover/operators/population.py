"""The reference population and the part of it a dataset can come from."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constraints as con


@dataclass(frozen=True)
class Scope:
    """What is known about where the dataset was drawn from: criteria a row must satisfy, and
    exclusions it must not. A constraint is ``(lo, hi)``, a set of texts, or None (anything)."""

    criteria: Mapping = field(default_factory=dict)
    exclude: Mapping = field(default_factory=dict)
    description: str = ""

    def __and__(self, other: Scope) -> Scope:
        for mine, theirs, what in ((self.criteria, other.criteria, "criterion"),
                                   (self.exclude, other.exclude, "exclusion")):
            twice = sorted(set(mine) & set(theirs))
            if twice:
                raise ValueError(f"{what} on {twice[0]!r} given twice")
        text = " and ".join(d for d in (self.description, other.description) if d)
        return Scope({**self.criteria, **other.criteria}, {**self.exclude, **other.exclude}, text)

    def predicate(self) -> Column:
        cond = F.lit(True)
        for column, c in self.criteria.items():
            cond = cond & con.satisfies(F.col(column), c)
        for column, c in self.exclude.items():
            if c is not None:   # a row with an unknown value is not excluded
                cond = cond & ~F.coalesce(con.satisfies(F.col(column), c), F.lit(False))
        return cond

    @property
    def everything(self) -> bool:
        return not any(c is not None for c in (*self.criteria.values(), *self.exclude.values()))


@dataclass(frozen=True)
class Population:
    """One row per member of the population, its scope, and where it came from."""

    df: DataFrame
    scope: Scope = Scope()
    sources: Mapping[str, str] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def require(self, *columns: str) -> None:
        for c in columns:
            if c not in self.df.columns:
                raise KeyError(f"population has no column {c!r}; available: "
                               + ", ".join(self.df.columns))

    def within(self, scope: Scope) -> Population:
        return Population(self.df, self.scope & scope, self.sources)

    def rows(self) -> DataFrame:
        """The rows within the scope."""
        self.require(*self.scope.criteria, *(c for c, v in self.scope.exclude.items()
                                             if v is not None))
        return self.df if self.scope.everything and not self.scope.criteria \
            else self.df.where(self.scope.predicate())

    def size(self) -> int:
        return self.rows().count()

    def distinct(self, column: str) -> DataFrame:
        """The known values of a column, in the whole population (not only the scope)."""
        self.require(column)
        return self.df.select(column).where(F.col(column).isNotNull()).distinct()

    def snapshot(self) -> str:
        return "; ".join(f"{k} {v}" for k, v in sorted(self.sources.items())) or "unknown"

    def most_frequent(self, column: str, key: str) -> DataFrame:
        """Per value of ``key`` the most frequent value of ``column`` (the whole population);
        equally frequent values: the first in alphabetical order. Two aggregations that both
        combine before they shuffle, so a key with most of the rows is no hot spot."""
        self.require(column, key)
        pairs = (self.df.select(F.col(key).cast("string").alias("key"),
                                F.col(column).cast("string").alias("value"))
                 .where(F.col("key").isNotNull() & F.col("value").isNotNull())
                 .groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")))
        return pairs.groupBy("key").agg(
            F.min(F.struct((-F.col("n")).alias("n"), "value")).getField("value").alias("value"))
