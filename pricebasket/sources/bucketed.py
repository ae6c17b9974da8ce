"""Observations and items as tables bucketed by item, which are joined where they lie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebasket.functions.text import dollars

#: Buckets of both tables: their number must be the same, and is chosen for the larger one, so that a bucket of a dataset fits into a task.
BUCKETS = 64


def write_bucketed(rows: DataFrame, name: str, path: str, datasets: bool = False, buckets: int = BUCKETS) -> None:
    """rows as the table `name` at a path, sorted within buckets of item_id, one file a bucket (and dataset, where each has its own folder)."""
    dealt = rows.repartition(buckets, "item_id").write.bucketBy(buckets, "item_id").sortBy("item_id").option("path", path).mode("overwrite")
    (dealt.partitionBy("dataset") if datasets else dealt).saveAsTable(name)


def joined_bucketed(spark: SparkSession, observations: str, items: str, outlets: DataFrame, dataset: str) -> DataFrame:
    """What joined_observations gives, over bucketed tables: observations and items meet without an exchange, then each row's outlet is looked up."""
    if not dataset:
        raise ValueError("a dataset must be named")
    own = spark.table(observations).filter(F.col("dataset") == dataset).select("period", "item_id", "observed_name", "price_cents")
    named = spark.table(items).select("item_id", F.col("canonical_name").alias("item"), "size_value", "size_unit", "outlet_id")
    outlet = outlets.select(F.col("id").alias("outlet_id"), F.col("name").alias("outlet"), "category")
    return own.join(named.hint("merge"), "item_id").join(outlet, "outlet_id").withColumn("price", dollars(F.col("price_cents")))
