"""Sinks and resumable output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_forecasts(df: DataFrame, parquet: str, csv: str | None = None) -> None:
    """Forecast rows by strategy: a folder per strategy, clustered so that each task writes few files."""
    df.repartition("strategy", "meter_id").sortWithinPartitions("strategy", "meter_id", "ts").write.mode("overwrite").partitionBy("strategy").parquet(parquet)
    if csv:
        df.write.mode("overwrite").csv(csv, header=True)


def read_forecasts(spark: SparkSession, parquet: str, strategy: str | None = None) -> DataFrame:
    df = spark.read.parquet(parquet)
    return df if strategy is None else df.filter(F.col("strategy") == strategy)


def write_manifest(models: DataFrame, path: str, fields: list[str]) -> None:
    """One JSON row per model; absent fields are null."""
    have = set(models.columns)
    models.select(*[F.col(f) if f in have else F.lit(None).cast("string").alias(f) for f in fields]).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def pending(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys that an earlier run has not produced."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def append_rows(df: DataFrame, path: str, by: str) -> None:
    """Add rows of keys that are not there yet (see ``pending``); the commit protocol drops files of a failed run."""
    df.write.mode("append").partitionBy(by).parquet(path)
