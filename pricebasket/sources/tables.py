"""Reading and writing the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebasket.sources import schemas


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, with its columns and no inference."""
    return spark.read.schema(schema).parquet(path)


def read_observations(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """One dataset's observations; there is no default dataset. Other datasets' partitions are not read."""
    if not dataset:
        raise ValueError("a dataset must be named")
    return read_table(spark, path, schemas.OBSERVATIONS).filter(F.col("dataset") == dataset)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page snapshots (S4): input only, their HTML goes to no output."""
    return read_table(spark, path, schemas.PAGES)


def write_observations(merged: DataFrame, path: str) -> None:
    """Replaces the (dataset, period) partitions that the rows are in, and no other (S5). The rows must not come from the same files unless stored before."""
    merged.repartition(
        "dataset", "period", F.pmod(F.xxhash64("item_id"), F.lit(16))
    ).write.option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "period").mode("overwrite").parquet(path)


def append_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """Adds rows to the collection log (S6); mode overwrite for a folder of its own that a repeated batch writes again."""
    log.select("outlet_id", "ran_at", "status", "reason", F.coalesce("items_found", F.lit(0)).cast("int").alias("items_found")).write.mode(mode).parquet(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, all columns."""
    return spark.createDataFrame([], schema)
