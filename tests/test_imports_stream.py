"""Imports resolved as a stream: cut anywhere, it gives the statuses of one import."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import duplicates
from ledgerspark.plans import duplicate_queries
from ledgerspark.streaming import imports

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("cuts", [1, 4])
def test_a_stream_cut_anywhere(spark, tmp_path, cuts):
    rows = duplicate_queries.imported(spark, DIR).select(*duplicates.FACTS).orderBy("txn_id").toPandas()
    at = sorted(random.Random(cuts).sample(range(1, len(rows)), cuts - 1))
    schema = duplicate_queries.imported(spark, DIR).select(*duplicates.FACTS).schema
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = imports.resolve(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), days=10_000)
    out = str(tmp_path / "out")
    for lo, hi in zip([0, *at], [*at, len(rows)], strict=True):  # each part is a micro-batch of its own, after a restart
        spark.createDataFrame(rows[lo:hi], schema).coalesce(1).write.mode("append").parquet(source)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r.txn_id: r.status for r in spark.read.parquet(out).collect()}
    want = {r.txn_id: r.status for r in duplicates.resolve(duplicate_queries.imported(spark, DIR)).collect()}
    assert got == want and set(got.values()) == {"accepted", "probable", "exact"}


def test_state_keeps_the_last_days_only(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    schema = "txn_id long, source_fingerprint string, account_id long, txn_date date, amount decimal(18,2), text string, external_id string"
    stream = imports.resolve(spark.readStream.schema(schema).parquet(source), days=5)
    for part in ([(1, "a", 1, "2026-01-01", 5, "shop", None), (2, "b", 2, "2026-01-01", 5, None, None)], [(3, "c", 1, "2026-01-20", 6, "shop", None)], [(4, "a", 1, "2026-01-01", 5, "shop", None), (5, "c", 1, "2026-01-20", 6, "shop", None), (6, "z", 2, "2026-01-02", 5, None, None)]):
        rows = spark.createDataFrame(part, schema.replace("date,", "string,").replace("decimal(18,2)", "long")).withColumn("txn_date", F.to_date("txn_date")).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
        rows.coalesce(1).write.mode("append").parquet(source)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert {r.txn_id: r.status for r in spark.read.parquet(out).collect()} == {1: "accepted", 2: "accepted", 3: "accepted", 4: "accepted", 5: "exact", 6: "probable"}
