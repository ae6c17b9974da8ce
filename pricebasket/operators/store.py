"""Items, observations, outlets and log: merges and reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricebasket.functions.text import dollars

NATURAL = ("outlet_id", "match_key", "size_value", "size_unit")


def item_id() -> Column:
    """An item's id: a hash of its natural key, the same in whatever order items come."""
    return F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in NATURAL))


def id_collisions(items: DataFrame) -> DataFrame:
    """Ids that stand for more than one natural key."""
    return items.groupBy("item_id").agg(F.count_distinct(F.struct(*NATURAL)).alias("keys")).filter("keys > 1")


def upsert_items(items: DataFrame, seen: DataFrame) -> DataFrame:
    """items with those of seen (natural key, canonical_name, period): first names and months stay, last_seen is the latest month (L3)."""
    new = seen.groupBy(*NATURAL).agg(
        F.min_by("canonical_name", "period").alias("_name"), F.min("period").alias("_from"), F.max("period").alias("_to")
    ).withColumnsRenamed({c: f"_{c}" for c in NATURAL})
    joined = items.join(new, [items[c].eqNullSafe(F.col(f"_{c}")) for c in NATURAL], "full_outer")
    whole = joined.select(
        *(F.when(F.col("item_id").isNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in NATURAL), "item_id",
        F.coalesce("canonical_name", "_name").alias("canonical_name"), F.least("first_seen", "_from").alias("first_seen"),
        F.greatest("last_seen", "_to").alias("last_seen")
    )
    return whole.withColumn("item_id", F.coalesce("item_id", item_id()))


def known_items(items: DataFrame, outlet_id: str) -> DataFrame:
    """L4."""
    return items.filter(F.col("outlet_id") == outlet_id).select("item_id", "match_key", "size_value", "size_unit", "canonical_name")


def upsert_observations(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One observation an item, month and dataset: the last written, of one page the later row (L6). Partial maxima precede the shuffle."""
    key = ("item_id", "period", "dataset")
    both = existing.select(*key, "price_cents", "observed_name", "scraped_at", F.lit(-1).alias("position")).unionByName(
        new.select(*key, "price_cents", "observed_name", "scraped_at", F.col("position").cast("int").alias("position"))
    )
    last = both.groupBy(*key).agg(F.max(F.struct("scraped_at", "position", "price_cents", "observed_name")).alias("r"))
    return last.select(*key, "r.price_cents", "r.observed_name", "r.scraped_at")


def sync_outlets(old: DataFrame, configured: DataFrame) -> DataFrame:
    """Configured outlets replace stored ones of their id; those no longer configured stay."""
    columns = ("id", "name", "category", "url")
    return configured.select(*columns).unionByName(old.select(*columns).join(configured.select("id"), "id", "left_anti"))


def clear_dataset(observations: DataFrame, items: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations and items that stay, and one row with how many observations go (L8). Items without observations in any dataset go."""
    kept = observations.filter(F.col("dataset") != dataset)
    removed = observations.agg(F.count_if(F.col("dataset") == dataset).alias("removed"))
    return kept, items.join(kept.select("item_id"), "item_id", "left_semi"), removed


def joined_observations(observations: DataFrame, items: DataFrame, outlets: DataFrame, dataset: str) -> DataFrame:
    """Observations with their items and outlets, for one dataset, with dollars (R1). The order is left to whoever exports."""
    if not dataset:
        raise ValueError("a dataset must be named")
    own = observations.filter(F.col("dataset") == dataset).select("period", "item_id", "observed_name", "price_cents")
    outlet = outlets.select(F.col("id").alias("outlet_id"), F.col("name").alias("outlet"), "category")
    named = items.select("item_id", F.col("canonical_name").alias("item"), "size_value", "size_unit", "outlet_id").join(outlet, "outlet_id")
    return own.join(named, "item_id").withColumn("price", dollars(F.col("price_cents")))


def available_datasets(observations: DataFrame) -> DataFrame:
    """R2."""
    return observations.select("dataset").distinct().orderBy("dataset")


def dataset_summary(observations: DataFrame, items: DataFrame, dataset: str) -> DataFrame:
    """One row: counts, and first and last month; zeros and nulls for no rows."""
    own = observations.filter(F.col("dataset") == dataset)
    of_item = own.groupBy("item_id").agg(F.count("*").alias("n"), F.collect_set("period").alias("periods")).join(items.select("item_id", "outlet_id"), "item_id")
    months = own.join(items.select("item_id"), "item_id", "left_semi").groupBy("period").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("periods"), F.min("period").alias("first_period"), F.max("period").alias("last_period")
    )
    whole = of_item.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("observations"), F.count("*").alias("items"), F.count_distinct("outlet_id").alias("outlets"))
    return whole.join(F.broadcast(months))


def recent_log(log: DataFrame, outlets: DataFrame, limit: int = 60) -> DataFrame:
    """The latest entries with their outlets' names (R4); ties by outlet."""
    latest = log.orderBy(F.desc("ran_at"), "outlet_id", "entry").limit(limit) if "entry" in log.columns else log.orderBy(F.desc("ran_at"), "outlet_id").limit(limit)
    named = latest.join(outlets.select(F.col("id").alias("outlet_id"), F.col("name").alias("outlet")), "outlet_id", "left")
    return named
