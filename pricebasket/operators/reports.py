"""Summaries of baskets, coverage and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricebasket.settings import DEFAULTS, Settings


def basket_summary(observations: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Items, those in the basket, outlets, months, raw observations, median months an item; no row for no input."""
    cells = observations.groupBy("item_id", "period").agg(F.count("*").alias("n"), F.min("outlet_id").alias("outlet_id"))
    of_item = cells.groupBy("item_id").agg(F.count("period").alias("months"), F.sum("n").alias("n"), F.min("outlet_id").alias("outlet_id"))
    whole = of_item.agg(
        F.count("item_id").alias("total_items"), F.count_if(F.col("months") >= settings.min_periods_per_item).alias("basket_items"),
        F.count_distinct("outlet_id").alias("outlets"), F.sum("n").alias("observations"), F.median("months").alias("median_periods")
    )
    months = observations.select("period").distinct().agg(F.count("period").alias("periods"))
    return whole.filter("observations > 0").join(F.broadcast(months))


def coverage(config: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each outlet's tier, page type and whether it is verified; and how many of all are not."""
    listed = config.select("id", "name", "category", F.coalesce("renderer", F.lit("static")).alias("renderer"), F.coalesce("verified", F.lit(False)).alias("verified"))
    return listed, listed.agg(F.count_if(~F.col("verified")).alias("unverified"), F.count("*").alias("total"))


def outcome(status: Column, error: Column, html: Column) -> Column:
    """skipped, error or fetched."""
    return F.when(status == "skipped", "skipped").when((status == "error") | error.isNotNull() | (F.coalesce(F.length(html), F.lit(0)) == 0), "error").otherwise("fetched")


def run_report(log: DataFrame, linked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One row for the run, one for each outlet (L10). linked: rows written, with is_new and renamed; counted before equal items collapse."""
    of_outlet = log.groupBy("outlet_id").agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in (("fetched", "fetched"), ("skipped", "skipped"), ("error", "errored"))))
    if linked is None:
        of_outlet = of_outlet.withColumns({c: F.lit(0).cast("bigint") for c in ("items_written", "new_items", "renames")})
    else:
        items = linked.groupBy("outlet_id").agg(F.count("*").alias("items_written"), F.count_if("is_new").alias("new_items"), F.count_if("renamed").alias("renames"))
        of_outlet = of_outlet.join(items, "outlet_id", "left").na.fill(0, ["items_written", "new_items", "renames"])
    sums = of_outlet.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("fetched", "skipped", "errored", "items_written", "new_items", "renames")))
    return sums.withColumn(
        "summary", F.format_string("%d fetched, %d skipped, %d errors, %d items written, %d new", "fetched", "skipped", "errored", "items_written", "new_items")
    ), of_outlet


def renames(linked: DataFrame) -> DataFrame:
    """Old key, new key and score of rows that an older key took in."""
    return linked.filter("renamed").select("outlet_id", "period", F.col("match_key").alias("old_key"), F.col("new_key"), F.round("score", 3).alias("score"))


def parse_report(pages: DataFrame, items: DataFrame, blocks: DataFrame) -> DataFrame:
    """Items, blocks and whether the sweep was used, for each page, pages without items too."""
    found = items.groupBy("outlet_id", "period").agg(F.count("*").alias("items"))
    seen = blocks.groupBy("outlet_id", "period").agg(F.max("blocks").alias("blocks_seen"), F.max("used_fallback").alias("used_fallback"), F.max("selector").alias("selector"))
    whole = pages.select("outlet_id", "period").distinct().join(found, ["outlet_id", "period"], "left").join(seen, ["outlet_id", "period"], "left")
    whole = whole.select(
        "outlet_id", "period", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("blocks_seen", F.lit(0)).alias("blocks_seen"),
        F.coalesce("used_fallback", F.lit(True)).alias("used_fallback"), F.coalesce("selector", F.lit("")).alias("_selector")
    )
    text = F.when(~F.col("used_fallback"), F.format_string("%d items from %d blocks", "items", "blocks_seen")).when(F.col("blocks_seen") == 0, F.format_string("selector '%s' matched nothing; generic sweep found %d items", "_selector", "items")).otherwise(
        F.format_string("selector '%s' matched %d blocks but no name/price pairs came out of them; generic sweep found %d items", "_selector", "blocks_seen", "items")
    )
    return whole.withColumn("notes", text).drop("_selector")
