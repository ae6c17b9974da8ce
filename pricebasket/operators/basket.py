"""The chained matched-model index (I1 to I11), for all slices at once.

Input: one row an observation with slice, item_id, period and price. Every frame that comes out carries the slice, so
the overall index and those of all categories are one job. All that is done row by row asks for rows of an item to be together, so input that is
dealt by item_id is not shuffled again; what leaves the items are sums by slice and two months, from which all else follows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricebasket.functions.text import category_label, period_order
from pricebasket.settings import DEFAULTS, Settings

OVERALL = "overall"
# The notes of points that no link stands behind.
BASE, NO_PAIRS, ALL_EXCLUDED = "base period", "no items priced in both months; index carried forward", "every matched item was excluded as implausible"


@dataclass(frozen=True)
class Index:
    points: DataFrame
    excluded: DataFrame
    links: DataFrame


def overall_slice(observations: DataFrame) -> DataFrame:
    return observations.withColumn("slice", F.lit(OVERALL))


def _enough(observations: DataFrame, settings: Settings) -> DataFrame:
    """The categories with enough outlets and items, counted on raw rows, each item's once. Items are counted where they are: what leaves them
    is a row an outlet. Broadcast: a row a category."""
    seen = observations.filter("category is not null").select("category", "outlet_id", "item_id").distinct()
    of_item = Window.partitionBy("item_id", "category").orderBy("outlet_id")
    new = seen.withColumn("_new", F.col("item_id").isNotNull() & (F.row_number().over(of_item) == 1))
    of_outlet = new.groupBy("category", "outlet_id").agg(F.count_if("_new").alias("_items"))
    return F.broadcast(
        of_outlet.groupBy("category").agg(F.count("outlet_id").alias("_outlets"), F.sum("_items").alias("_items"))
        .filter((F.col("_outlets") >= settings.min_outlets_per_category) & (F.col("_items") >= settings.min_items_per_category)).select("category")
    )


def category_slices(observations: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Rows of the categories with enough outlets and items; the slice is the category."""
    return observations.join(_enough(observations, settings), "category", "left_semi").withColumn("slice", F.col("category"))


def all_slices(observations: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Each row once overall, and once for its category if that has enough outlets and items; rows stay where they are."""
    enough = _enough(observations, settings).withColumn("_shown", F.col("category"))
    return observations.join(enough, "category", "left").withColumn("slice", F.explode(F.array_compact(F.array(F.lit(OVERALL), "_shown")))).drop("_shown")


def judge(pairs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Pairs of previous and current prices with the change and whether it is too large a jump to be true."""
    change = F.when(F.col("previous") != 0, (F.try_divide(F.col("price"), F.col("previous")) - 1) * 100)
    jump = F.when(F.col("previous") == 0, F.col("price") != 0).otherwise(F.abs(change) > settings.max_monthly_change_pct)
    return pairs.withColumn("change_pct", change).withColumn("_jump", jump)


def link_sums(judged: DataFrame, *keys: str) -> DataFrame:
    """For each of the keys the pairs, those that count, and the link: the ratio of the sums of their prices."""
    return judged.groupBy(*keys).agg(
        F.count("*").alias("candidates"), F.count_if(~F.col("_jump")).alias("matched_items"),
        F.try_divide(F.sum(F.when(~F.col("_jump"), F.col("price"))), F.nullif(F.sum(F.when(~F.col("_jump"), F.col("previous"))), F.lit(0.0))).alias("link"),
    )


def excluded_moves(judged: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    reason = F.lit(f"move above the {settings.max_monthly_change_pct:.0f}% plausibility limit")
    return judged.filter("_jump").select("slice", "period", "item_id", F.col("previous").alias("from"), F.col("price").alias("to"), "change_pct", reason.alias("reason"))


def chain(linked: DataFrame, single: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Points (I7, I8) of each slice's months (slice, period, ord) with their links, if they have one, and of slices of a single month, if these stand apart."""
    chained = Window.partitionBy("slice").orderBy("ord")
    full = linked.withColumn("_link", F.coalesce("link", F.lit(1.0)))
    note = F.when(F.col("ord") == 1, BASE).when(F.coalesce("candidates", F.lit(0)) == 0, NO_PAIRS).when(F.col("matched_items") == 0, ALL_EXCLUDED).otherwise("")
    value = F.lit(settings.base_value) * F.product("_link").over(chained)
    points = full.select(
        "slice", "period", "ord", value.alias("value"), F.coalesce("matched_items", F.lit(0)).cast("bigint").alias("matched_items"),
        F.col("_link").alias("link"), note.alias("note")
    )
    if single is None:
        return points
    alone = single.select(
        "slice", "period", F.lit(1).alias("ord"), F.lit(settings.base_value).alias("value"), F.lit(0).cast("bigint").alias("matched_items"),
        F.lit(1.0).alias("link"), F.lit(BASE).alias("note")
    )
    return points.unionByName(alone)


def numbered(periods: DataFrame) -> DataFrame:
    """Months (slice, period) with their order in the slice."""
    return periods.withColumn("ord", F.row_number().over(Window.partitionBy("slice").orderBy(period_order(F.col("period")), "period")))


def _in_time(sliced: DataFrame, settings: Settings) -> DataFrame:
    """A row a slice, item and month: its price, the item's month before and its price, judged; and whether the item has enough months."""
    named = sliced.filter("item_id is not null and period is not null")
    priced = named.groupBy("slice", "item_id", "period").agg(F.avg("price").alias("price"))
    of_item = Window.partitionBy("slice", "item_id")
    ordered = of_item.orderBy(period_order(F.col("period")), "period")
    lagged = priced.withColumns({"previous": F.lag("price").over(ordered), "before": F.lag("period").over(ordered)})
    kept = lagged.withColumn("_kept", F.count("*").over(of_item) >= settings.min_periods_per_item)  # after the lag: one sort serves both
    paired = F.col("_kept") & F.col("before").isNotNull() & F.col("price").isNotNull() & F.col("previous").isNotNull()
    return judge(kept.withColumn("_paired", paired), settings)


def _linked(rows: DataFrame) -> DataFrame:
    """Months (slice, period) with their order, the month before, and the sums of the pairs between the two, null for no pairs."""
    used = F.col("_paired") & ~F.col("_jump")
    sums = rows.groupBy("slice", "before", "period").agg(
        F.count_if("_kept").alias("_rows"), F.count_if("_paired").alias("candidates"), F.count_if(used).alias("matched_items"),
        F.sum(F.when(used, F.col("price"))).alias("price"), F.sum(F.when(used, F.col("previous"))).alias("previous"),
    )
    # at most as many entries as there are months before
    pairs = F.collect_list(F.when(F.col("candidates") > 0, F.struct("before", "candidates", "matched_items", "price", "previous")))
    months = sums.groupBy("slice", "period").agg(F.sum("_rows").alias("_rows"), pairs.alias("_pairs"))
    # a slice of one period is one base point, before any item is dropped
    alone = months.withColumn("_alone", F.count("*").over(Window.partitionBy("slice")) == 1)
    ordered = numbered(alone.filter("_alone or _rows > 0")).withColumn("before", F.lag("period").over(Window.partitionBy("slice").orderBy("ord")))
    pair = F.get(F.filter("_pairs", lambda x: x.before == F.col("before")), F.lit(0))
    return ordered.withColumn("_pair", pair).select(
        "slice", "before", "period", "ord", "_pair.candidates", "_pair.matched_items",
        F.try_divide("_pair.price", F.nullif("_pair.previous", F.lit(0.0))).alias("link"),
    )


def build_index(sliced: DataFrame, settings: Settings = DEFAULTS) -> Index:
    rows = _in_time(sliced, settings)
    linked = _linked(rows)
    neighbours = F.broadcast(linked.select("slice", "before", "period"))  # a row a slice and month
    jumps = rows.filter("_paired and _jump").join(neighbours, ["slice", "before", "period"])
    return Index(chain(linked, settings=settings), excluded_moves(jumps, settings), linked.filter("candidates is not null").drop("before"))


def published_points(points: DataFrame) -> DataFrame:
    """Points as stored: values of 2 decimals, links of 6."""
    return points.withColumns({"value": F.round("value", 2), "link": F.round("link", 6)})


def published_excluded(excluded: DataFrame) -> DataFrame:
    return excluded.withColumns({"from": F.round("from", 2), "to": F.round("to", 2), "change_pct": F.round("change_pct", 1)})


def index_summary(published: DataFrame) -> DataFrame:
    """slice, latest period and value, total change of the published values; the change is null with fewer than two points."""
    whole = published.groupBy("slice").agg(
        F.count("*").alias("points"), F.min_by("value", "ord").alias("_first"), F.max_by("value", "ord").alias("latest_value"),
        F.max_by("period", "ord").alias("latest_period")
    )
    return whole.select(
        "slice", "points", "latest_period", "latest_value",
        F.when(F.col("points") > 1, (F.try_divide(F.col("latest_value"), F.nullif("_first", F.lit(0.0))) - 1) * 100).alias("total_change_pct")
    )


def category_summary(summary: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """Label, description, change of 2 decimals (0 if there is none) and latest value of each category."""
    own = summary.withColumn("label", category_label(F.col("slice"))).withColumn("change_pct", F.round(F.coalesce("total_change_pct", F.lit(0.0)), 2))
    if descriptions is None:
        own = own.withColumn("description", F.lit(None).cast("string"))
    else:
        own = own.join(descriptions.select(F.col("category").alias("slice"), "description"), "slice", "left")
    return own.select("slice", "label", "description", "change_pct", "latest_value")
