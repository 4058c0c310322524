"""Quarterly aggregates kept up batch by batch.

The table holds counts, which add up, by quarter. A batch is counted, its quarters are
read, and a version with these quarters' new counts is committed (see versioned); other
quarters aren't opened. The manifest notes the batch's number, so a batch that a restarted
stream hands over again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.functions import scalars as S
from sparrowmill.versioned import Snapshot, VersionedTable

KEYS = ("district_id", "commodity", "quarter")


class QuarterlyAggregates:
    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path, "quarter")

    def merge(self, batch: DataFrame, number: int, usable: Column) -> Snapshot:
        """Count the usable rows of batch (KEYS but quarter, test_date, pass_fail) in, unless this or a later batch is in already."""
        base = self.table.snapshot()
        if number <= base.notes.get("batch", -1):
            return base
        grouped = batch.where(usable).groupBy("district_id", "commodity", S.quarter_label(F.col("test_date")).alias("quarter"))
        counted = grouped.agg(F.count(F.lit(1)).alias("n_tests"), F.count_if(F.col("pass_fail") == F.lit(False)).alias("n_failed")).where("quarter is not null").persist()
        try:
            quarters = [r[0] for r in counted.select("quarter").distinct().collect()]  # four a year
            if not quarters:
                return base
            before = self.table.read(base, quarters).select(counted.columns) if base.version else counted.limit(0)
            summed = before.unionByName(counted).groupBy(*KEYS).agg(F.sum("n_tests").alias("n_tests"), F.sum("n_failed").alias("n_failed"))
            return self.table.replace(summed, base, {"batch": number})
        finally:
            counted.unpersist()

    def follow(self, stream: DataFrame, usable: Column, checkpoint: str) -> None:
        """Merge all batches that a stream has now."""
        writer = stream.writeStream.foreachBatch(lambda batch, number: self.merge(batch, number, usable) and None)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def current(self) -> DataFrame:
        """KEYS, n_tests, fail_rate, risk_score."""
        rate = S.fail_rate(F.col("n_failed"), F.col("n_tests"))
        return self.table.read().select(*KEYS, "n_tests", rate.cast("double").alias("fail_rate"), F.round(rate * 100, 2).cast("double").alias("risk_score"))
