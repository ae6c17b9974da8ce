"""First-to-last price changes of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebasket.functions.text import period_order


def item_price_changes(observations: DataFrame, published: bool = True) -> DataFrame:
    """Unless published, figures are not rounded. From (item_id, item, outlet, category, period, price): two aggregates, the second on few rows an item."""
    priced = observations.groupBy("item_id", "period").agg(
        F.avg("price").alias("price"), F.min("item").alias("item"), F.min("outlet").alias("outlet"), F.min("category").alias("category")
    ).filter("price is not null")
    at, when = F.struct("period", "price"), F.struct(period_order(F.col("period")), "period")
    whole = priced.groupBy("item_id").agg(
        F.count("*").alias("_n"), F.min_by(at, when).alias("a"), F.max_by(at, when).alias("b"), F.min("item").alias("item"), F.min("outlet").alias("outlet"),
        F.min("category").alias("category")
    )
    whole = whole.filter("_n > 1 and a.price > 0")
    out = whole.select(
        "item_id", "item", "outlet", "category", F.col("a.period").alias("first_period"), F.col("b.period").alias("last_period"), F.col("a.price").alias("first_price"), F.col("b.price").alias("last_price"),
        ((F.col("b.price") / F.col("a.price") - 1) * 100).alias("change_pct"), (F.col("b.price") - F.col("a.price")).alias("change_dollars"),
    )
    return out.withColumns({c: F.round(c, n) for c, n in (("first_price", 2), ("last_price", 2), ("change_pct", 1), ("change_dollars", 2))}) if published else out


def increases(changes: DataFrame, n: int = 15) -> DataFrame:
    return changes.filter("change_pct > 0").orderBy(F.desc("change_pct"), "item_id").limit(n)


def decreases(changes: DataFrame, n: int = 15) -> DataFrame:
    return changes.filter("change_pct < 0").orderBy("change_pct", "item_id").limit(n)
