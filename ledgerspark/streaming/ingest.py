"""Ledger files as a stream: daily spend with a watermark, and an append that takes every row once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.sources.store import append_new


def files(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def daily_spend(events: DataFrame, at: str = "ts", late: str = "2 days") -> DataFrame:
    """Spend of each account and day; a day is final once the watermark has passed it."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day"), "account_id").agg(F.sum("amount").alias("spend"), F.count("*").alias("rows"))


def append_batches(stream: DataFrame, target: str, checkpoint: str, *keys: str, by: str | None = None):
    """A query that appends each micro-batch's new rows; a batch that runs again adds nothing.

    ``by``: a time or date that goes with the keys. The target is then partitioned by its day (``_day``),
    and a batch is compared with the partitions of its own days only.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if by is not None:
            batch = batch.withColumn("_day", F.to_date(by))
        try:
            existing = spark.read.schema(batch.schema).parquet(target)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            existing = batch.limit(0)
        if by is not None:
            days = [r[0] for r in batch.select("_day").distinct().collect()]  # the days of one micro-batch
            existing = existing.filter(F.col("_day").isin([d for d in days if d is not None]) | F.lit(None in days) & F.col("_day").isNull())
        writer = append_new(existing, batch, *keys).write.mode("append")
        (writer if by is None else writer.partitionBy("_day")).parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
