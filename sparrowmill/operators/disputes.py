"""Disputes as events: what was submitted and how it was reviewed give every state, so nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.functions import scalars as S

#: What a review may decide.
OUTCOMES = ("resolved_removed", "resolved_kept", "resolved_flagged")


def states(submissions: DataFrame, reviews: DataFrame, brands: DataFrame) -> DataFrame:
    """submissions (dispute_id, brand_id, record_id, email, at) of known brands with status, resolved_at.

    reviews: dispute_id, review_id, outcome, at. Only OUTCOMES count, of several the
    latest; a dispute without one is pending. Disputes of unknown brands are left out.
    """
    known = submissions.join(brands.select("brand_id"), "brand_id", "left_semi")
    last = reviews.where(F.col("outcome").isin(*OUTCOMES)).groupBy("dispute_id").agg(F.max(F.struct("at", "review_id", "outcome")).alias("r"))
    return known.join(last, "dispute_id", "left").select(*submissions.columns, F.coalesce("r.outcome", F.lit("pending")).alias("status"), F.col("r.at").alias("resolved_at"))


def brand_flags(disputes: DataFrame) -> DataFrame:
    """brand_id, dispute_count, n_open, under_dispute: under dispute while one is pending."""
    counted = disputes.groupBy("brand_id").agg(F.count(F.lit(1)).alias("dispute_count"), F.count_if(F.col("status") == "pending").alias("n_open"))
    return counted.withColumn("under_dispute", F.col("n_open") > 0)


def without_confidence(records: DataFrame, disputes: DataFrame) -> DataFrame:
    """records with a confidence_score of 0 where a dispute over their record_id removed them."""
    removed = disputes.where((F.col("status") == "resolved_removed") & F.col("record_id").isNotNull()).select("record_id").distinct().withColumn("_removed", F.lit(True))
    score = F.when(F.col("_removed"), F.lit(0).cast(records.schema["confidence_score"].dataType)).otherwise(F.col("confidence_score"))
    return records.join(removed, "record_id", "left").withColumn("confidence_score", score).drop("_removed").select(*records.columns)


def audit(submissions: DataFrame, reviews: DataFrame, brands: DataFrame) -> DataFrame:
    """at, action, dispute_id, metadata (JSON) of each submission for a known brand and each valid review of one; others are refused before anything is written."""
    submissions = submissions.join(brands.select("brand_id"), "brand_id", "left_semi")
    sent = submissions.select("at", F.lit("dispute_submitted").alias("action"), "dispute_id", F.to_json(F.struct("dispute_id", "brand_id")).alias("metadata"))
    valid = reviews.where(F.col("outcome").isin(*OUTCOMES)).join(submissions.select("dispute_id"), "dispute_id", "left_semi")
    return sent.unionByName(valid.select("at", F.lit("dispute_reviewed").alias("action"), "dispute_id", F.to_json(F.struct("dispute_id", "outcome")).alias("metadata")))


def listed(disputes: DataFrame, brands: DataFrame, status: str | None = None, brand_id: int | None = None, newest_first: bool = False, limit: int | None = None) -> DataFrame:
    """Disputes with their brand's name and a redacted address, by submission time; status and brand where given."""
    chosen = disputes if status is None else disputes.where(F.col("status") == status)
    chosen = chosen if brand_id is None else chosen.where(F.col("brand_id") == brand_id)
    joined = chosen.join(brands.select("brand_id", "brand_name"), "brand_id").withColumn("email", S.redact_email(F.col("email")))
    when = F.desc_nulls_last("at") if newest_first else F.asc_nulls_last("at")
    ordered = joined.orderBy(when, "dispute_id")
    return ordered if limit is None else ordered.limit(limit)
