"""Resumable ingestion: each quarter's pairs once, as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def distinct_pairs(batch: DataFrame, held: DataFrame | None, keys: list[str]) -> DataFrame:
    """Pairs of a batch that are not held yet."""
    new = batch.select(*keys).where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).distinct()
    return new if held is None else new.join(held.select(*keys), keys, "left_anti")


def accumulate_pairs(spark: SparkSession, stream: DataFrame, keys: list[str], table: str, checkpoint: str) -> StreamingQuery:
    """Add new distinct pairs of a stream to a Parquet table, one folder for each batch, so that a repeated batch overwrites itself."""
    from foliolens.sources.durable import exists

    def write(batch: DataFrame, number: int) -> None:
        held = None
        if exists(spark, table):
            held = spark.read.schema(batch.select(*keys).schema).option("recursiveFileLookup", "true").parquet(table).withColumn("file", F.input_file_name()).where(~F.col("file").contains(f"/batch={number}/"))
        distinct_pairs(batch, held, keys).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def presence(pairs: DataFrame, entity: str, period: str) -> DataFrame:
    """First and last period and number of periods of each entity, from accumulated pairs."""
    return pairs.groupBy(entity).agg(F.min(period).alias("first_period"), F.max(period).alias("last_period"), F.count_distinct(period).alias("n_periods"))


def event_counts(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums of events by type and time window; rows later than the watermark are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")
