"""Who may see which rows, and look-ups that must find something."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NotFound(LookupError):
    """No row has the key that was asked for."""


def visible(rows: DataFrame, owner: str, user: object | None, public: Column | None = None) -> DataFrame:
    """Row-level security as a filter: rows whose owner is user, and those for which public holds; without user only the latter.

    A plain filter, so it reaches the scan, and no view that the next user's would overwrite.
    """
    own = F.lit(False) if user is None else F.coalesce(F.col(owner) == F.lit(user), F.lit(False))
    return rows.where(own if public is None else own | F.coalesce(public, F.lit(False)))


def by_key(rows: DataFrame, column: str, value: object, what: str = "row") -> DataFrame:
    """The first row whose column is value; NotFound, before anything else runs, if there is none."""
    found = rows.where(F.col(column) == F.lit(value)).limit(1)
    if found.isEmpty():
        raise NotFound(f"{what} {value!r} not found")
    return found
