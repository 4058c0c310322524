"""Canonical names by exact alias, else by token-sorted similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.functions import scalars as S
from sparrowmill.operators.similar import similar
from sparrowmill.storage import written


def canonicalise(rows: DataFrame, column: str, aliases: DataFrame, least: float, more: DataFrame | None = None) -> DataFrame:
    """rows with canonical and score (0 to 100; both null below least), and with the columns of more (by canonical) where it is given.

    aliases: rank, alias, canonical. Names are made distinct before anything is
    compared. Exact ones (trimmed, lower-cased) are joined; the rest meet the aliases
    over an index of letter pairs (see similar). Ties go to the lower rank.
    The names are stored once and so is what was found, whose size Spark then knows: rows
    are read once for their names, and are shuffled only where the names are too many to broadcast.
    """
    key = F.lower(F.trim(F.col(column)))
    names = written(rows.select(key.alias("_key")).where("_key is not null").distinct(), "names")
    exact = names.join(aliases.select(F.col("alias").alias("_key"), "canonical"), "_key").select("_key", "canonical", F.lit(100.0).alias("score"))
    open_ = names.join(aliases.select(F.col("alias").alias("_key")), "_key", "left_anti").withColumn("_sorted", S.sort_tokens(F.col("_key")))
    ready = aliases.select("rank", "canonical", S.sort_tokens(F.col("alias")).alias("_alias"))
    pairs = similar(open_.select(F.col("_sorted").alias("a")), ready.select(F.col("_alias").alias("b")), least)
    scored = open_.join(pairs, F.col("_sorted") == F.col("a")).join(ready, F.col("b") == F.col("_alias")).select("_key", "canonical", "rank", "score")
    best = scored.groupBy("_key").agg(F.min(F.struct((-F.col("score")).alias("s"), "rank", "canonical", "score")).alias("b"))
    found = exact.unionByName(best.select("_key", "b.canonical", "b.score"))
    if more is not None:
        found = found.join(more, "canonical", "left")
    return rows.withColumn("_key", key).join(written(found, "found"), "_key", "left").drop("_key")
