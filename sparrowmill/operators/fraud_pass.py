"""A fraud pass: which results are scored, and what is written back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a pass writes back to each result.
COLUMNS = ("fraud_flags", "fraud_score", "geo_plausibility_ok", "value_is_round", "lab_flagged")


def selected(facts: DataFrame, key: str, ids: DataFrame | None, as_of: str, days: int = 7) -> DataFrame:
    """Results of the ids given (a column key); without ids, those parsed in the last days that are no duplicates.

    A table of ids without rows selects nothing, unlike none at all.
    """
    if ids is not None:
        return facts.join(ids.select(key).distinct(), key, "left_semi")
    return facts.where((F.col("parsed_at") >= F.date_sub(F.lit(as_of).cast("date"), days)) & ~F.col("is_duplicate"))


def write_back(facts: DataFrame, scored: DataFrame, key: list[str]) -> DataFrame:
    """facts with COLUMNS from scored where it has the key; others keep theirs."""
    new = scored.select(*key, *[F.col(c).alias(f"_{c}") for c in COLUMNS], F.lit(True).alias("_scored"))
    out = facts.join(new, key, "left")
    for c in COLUMNS:
        out = out.withColumn(c, F.when(F.col("_scored"), F.col(f"_{c}")).otherwise(F.col(c)))
    return out.select(*facts.columns)


def append_audit(audit: DataFrame, scored: DataFrame, key: list[str]) -> DataFrame:
    """audit (key, flag_type, score) and the flags of scored that it doesn't hold yet, so that a repeated pass adds nothing."""
    each = scored.select(*key, F.explode("fraud_flags").alias("f")).select(*key, F.col("f.type").alias("flag_type"), F.col("f.score").alias("score"))
    return audit.unionByName(each.join(audit, [*key, "flag_type"], "left_anti").select(*audit.columns))
