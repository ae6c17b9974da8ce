"""Official series: rebasing, changes over spans, comparison with an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebasket.functions.text import period_order


def rebase(series: DataFrame, period: str | DataFrame, value: str = "value") -> DataFrame:
    """The series with 100 at a period, its first row counting; unchanged where that has no value or 0.

    period: a month, or a frame of one row and one column that holds it.
    """
    wanted = series.filter(F.col("period") == period) if isinstance(period, str) else series.join(F.broadcast(period.toDF("period").limit(1)), "period", "left_semi")
    base = wanted.agg(F.first(value).alias("_base"))  # one row, whatever the series
    return series.join(F.broadcast(base)).withColumn(
        value, F.when(F.coalesce(F.col("_base"), F.lit(0.0)) != 0, F.col(value) / F.col("_base") * 100).otherwise(F.col(value))
    ).drop("_base")


def change_over(series: DataFrame, periods: DataFrame, value: str = "cpi") -> DataFrame:
    """One row: overlaps, first and last month and value, and change_pct of the series over the months of another; null change for too few months."""
    months = periods.select("period").distinct()
    n = months.agg(F.count("*").alias("_months"))
    when = period_order(F.col("period"))
    own = series.join(months, "period", "left_semi").agg(
        F.count("*").alias("overlaps"), F.min_by("period", when).alias("first_period"), F.max_by("period", when).alias("last_period"), F.min_by(value, when).alias("first_value"), F.max_by(value, when).alias("last_value"))
    change = F.when((F.col("_months") > 1) & (F.col("overlaps") > 1), (F.try_divide(F.col("last_value"), F.nullif("first_value", F.lit(0.0))) - 1) * 100)
    return own.join(F.broadcast(n)).withColumn("change_pct", change).drop("_months")


def whole_change(series: DataFrame, value: str = "cpi") -> DataFrame:
    """The change over the whole series."""
    return change_over(series, series.select("period"), value)


def comparison(own: DataFrame, cpi: DataFrame, name: str, cpi_name: str, rebase_both: bool = False) -> DataFrame:
    """period, value, series: the own series, and the official one rebased to its first month in common, if there are two."""
    shared = cpi.join(own.select("period").distinct(), "period", "left_semi")
    first = shared.agg(F.when(F.count("*") > 1, F.min_by("period", period_order(F.col("period")))).alias("period"))
    enough = shared.join(F.broadcast(first.filter("period is not null").select(F.lit(True).alias("_yes"))))
    official = rebase(enough.select("period", F.col("cpi").alias("value")), first)
    mine = rebase(own.select("period", "value"), first) if rebase_both else own.select("period", "value")
    return mine.withColumn("series", F.lit(name)).unionByName(official.withColumn("series", F.lit(cpi_name)))


def headline(summary: DataFrame, cpi_change: DataFrame, span: DataFrame) -> DataFrame:
    """Own change (0 if none), the official change, the gap in points and how they compare (C4). One row each."""
    one = summary.select(F.coalesce("total_change_pct", F.lit(0.0)).alias("own_change_pct")).join(
        F.broadcast(cpi_change.select(F.col("change_pct").alias("cpi_change_pct")))
    ).join(F.broadcast(span))
    gap = F.col("own_change_pct") - F.col("cpi_change_pct")
    return one.withColumn("gap_points", gap).withColumn("verdict", F.when(gap > 0, "faster than").when(gap <= 0, "slower than"))
