"""Session helper used by the bench, the tests and ad-hoc scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "ledgerspark", cpus: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings every job here relies on: UTC, AQE and Arrow."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read from there: a plan that grows from round to round ends here.

    The folder is ``spark.checkpoint.dir``; only a local session without it gets one of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or "/tmp/checkpoints")
    return df.checkpoint()
