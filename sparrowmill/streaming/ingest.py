"""Batches of new results as a stream: each run takes what is there and stops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.storage import shared_dir


def event_windows(spark: SparkSession, d: str, size: str = "1 day", late: str = "7 days") -> DataFrame:
    """Events and their value per type and window, kept up by a stream with a watermark.

    State holds only windows younger than the watermark; each micro-batch stores the
    windows that it changed under its number, and the latest number of a window counts.
    """
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))

    def store(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").cast("date").cast("string").alias("day"), "event_type", "n", "total").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/data/run={number}")

    query = counted.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    stored = spark.read.parquet(f"{out}/data").groupBy("day", "event_type").agg(F.max(F.struct("batch", "n", "total")).alias("last"))
    return stored.select("day", "event_type", "last.n", F.col("last.total").cast("double").alias("total"))
