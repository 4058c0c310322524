"""Constraints of tables: checks of a row, references to another table, uniqueness, each kind in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """Broken where the condition is false; a null condition is no breach, as in SQL."""

    name: str
    holds: Column


@dataclass(frozen=True)
class Required:
    """Broken where the column is null."""

    column: str

    @property
    def name(self) -> str:
        return f"{self.column}_required"


@dataclass(frozen=True)
class Reference:
    """Broken where column isn't null and parent has no row with that key."""

    name: str
    column: str
    parent: DataFrame
    key: str


@dataclass(frozen=True)
class Unique:
    """Broken by every row whose columns, none of them null, are also another row's."""

    name: str
    columns: tuple[str, ...]


Constraint = Check | Required | Reference | Unique


def one_of(column: str, values: tuple[str, ...]) -> Check:
    return Check(f"{column}_value", F.col(column).isin(*values))


def broken(rows: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """rows with broken: the names of the constraints that a row breaks, in the order given.

    Checks are projected; each reference joins the parent's different keys, each uniqueness the keys that occur twice
    or more, which are counted with map-side sums, so a hot key is one row on that side.
    """
    marks: dict[str, Column] = {}
    out = rows
    for k, c in enumerate(constraints):
        if isinstance(c, Check):
            marks[c.name] = ~F.coalesce(c.holds, F.lit(True))
        elif isinstance(c, Required):
            marks[c.name] = F.col(c.column).isNull()
        elif isinstance(c, Reference):
            keys = c.parent.select(F.col(c.key).alias(f"_key{k}")).where(F.col(f"_key{k}").isNotNull()).distinct()
            out = out.join(keys, F.col(c.column) == F.col(f"_key{k}"), "left")
            marks[c.name] = F.col(c.column).isNotNull() & F.col(f"_key{k}").isNull()
        else:
            names = [f"_key{k}_{n}" for n in range(len(c.columns))]
            filled = [F.col(x).isNotNull() for x in c.columns]
            own = rows
            for condition in filled:
                own = own.where(condition)
            twice = own.groupBy(*[F.col(x).alias(n) for x, n in zip(c.columns, names)]).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
            same = [F.col(x) == F.col(n) for x, n in zip(c.columns, names)]
            condition = same[0]
            for more in same[1:]:
                condition = condition & more
            out = out.join(twice, condition, "left")
            marks[c.name] = F.col(names[0]).isNotNull()
    listed = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in marks.items()])) if marks else F.expr("cast(array() as array<string>)")
    return out.withColumn("broken", listed).select(*rows.columns, "broken")


def quarantine(rows: DataFrame, constraints: list[Constraint]) -> tuple[DataFrame, DataFrame]:
    """The rows that break nothing, and the others with broken."""
    told = broken(rows, constraints)
    return told.where(F.size("broken") == 0).drop("broken"), told.where(F.size("broken") > 0)
