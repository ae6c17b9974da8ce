"""The official series' nested payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebasket.functions.text import cpi_period
from pricebasket.sources.schemas import PAYLOAD


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOAD).option("multiLine", True).json(path)


def flatten_series(payload: DataFrame, series_id: str) -> DataFrame:
    """period, cpi, year, month of one series' months; annual means and values that are no numbers drop out."""
    each = payload.filter("status = 'REQUEST_SUCCEEDED'").select(F.explode("Results.series").alias("s")).filter(F.col("s.seriesID") == series_id)
    entry = each.select(F.explode("s.data").alias("d"))
    period = cpi_period(F.col("d.year"), F.col("d.period"))
    rows = entry.select(
        period.alias("period"), F.col("d.value").try_cast("double").alias("cpi"), F.col("d.year").try_cast("int").alias("year"),
        F.substring("d.period", 2, 2).try_cast("int").alias("month")
    )
    return rows.filter("period is not null and cpi is not null")


def read_series(payload: DataFrame, series_id: str) -> DataFrame:
    """The series in order; ValueError if the request failed, the series is unknown or has no rows."""
    failed = payload.filter("status is null or status != 'REQUEST_SUCCEEDED'").select("status").limit(1).collect()
    if failed:
        raise ValueError(f"the request did not succeed: {failed[0]['status']}")
    rows = flatten_series(payload, series_id)
    if rows.isEmpty():
        raise ValueError(f"no rows for series {series_id!r}")
    return rows.orderBy("period")
