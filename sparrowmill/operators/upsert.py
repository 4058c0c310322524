"""Writes that change a table: the new whole is a DataFrame, stored beside the old and swapped by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowmill.storage import written


def upsert(old: DataFrame, new: DataFrame, keys: list[str], updated: list[str], defaults: dict[str, object]) -> DataFrame:
    """Rows of either table by key (nulls equal); columns in updated from new where there, all others from old, else their default."""
    n = new.select(*[F.col(k).alias(f"_n_{k}") for k in keys], *[F.col(c).alias(f"_u_{c}") for c in updated], F.lit(True).alias("_new"))
    condition = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_n_{k}"))
        condition = same if condition is None else condition & same
    joined = old.withColumn("_old", F.lit(True)).join(n, condition, "full")
    out = [F.when(F.col("_new").isNotNull(), F.col(f"_n_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    for c in old.columns:
        if c in keys:
            continue
        if c in updated:
            out.append(F.when(F.col("_new").isNotNull(), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_old").isNotNull(), F.col(c)).otherwise(F.lit(defaults.get(c))).alias(c))
    return joined.select(*out)


def in_order(rows: DataFrame, key: str, number: str) -> DataFrame:
    """rows with a gapless number from 1 in order of key, in as many tasks as there are ranges.

    Ranges are stored, as another run might cut them elsewhere; only their sizes are summed in one place.
    Nulls come first; equal keys are numbered in any order.
    """
    ranged = rows.repartitionByRange(key).withColumn("_range", F.spark_partition_id())
    stored = written(ranged, "ranges")
    sizes = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return stored.withColumn(number, own).join(F.broadcast(starts), "_range").withColumn(number, F.col(number) + F.col("_before")).drop("_range", "_before")


def insert_absent(old: DataFrame, names: DataFrame, key: str, id_column: str) -> DataFrame:
    """old and each new name once, with ids after the largest of old, in order of name."""
    fresh = names.select(key).where(F.col(key).isNotNull()).distinct().join(old.select(key), key, "left_anti")
    top = old.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))
    numbered = in_order(fresh, key, "_k").join(F.broadcast(top))
    return old.select(id_column, key).unionByName(numbered.select((F.col("_top") + F.col("_k")).cast(old.schema[id_column].dataType).alias(id_column), key))
