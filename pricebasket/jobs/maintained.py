"""The index maintained month by month over a store of committed snapshots.

Tables and their parts: `prices`, one row an item and month, by month; `item_months`, each item's months, by a hash of the item;
`months` (slice, period, items, eligible: how many items have a price in it, and how many of them are in the basket) and `links`
(slice, before, period and their sums), a few rows each; `excluded` by month. A slice is `overall` or a category.

When months are replaced or removed, items' months change only for items that came or went, and with them the counts by month.
The links to redo are those from or to such a month, those of neighbours that were none before, and, where items need more than two
months, those whose both months have an item that entered or left the basket. Only these links' months are read; all other sums
stay. Then the chain is multiplied anew from the links: a row a slice and month.

Rows without an item or a month are left out. An item's outlet and category are those of its last replaced row; that they change needs a
full build. The gates of categories count items and outlets that have any month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricebasket.functions.text import period_order
from pricebasket.operators import basket
from pricebasket.session import run_folder, stored
from pricebasket.settings import DEFAULTS, Settings
from pricebasket.sources.schemas import EXCLUDED
from pricebasket.sources.snapshots import Change, Snapshot, Store

PARTS = 64
# Prices that a task sorts by item and month, about.
ROWS_A_TASK = 250_000
PRICES = "item_id bigint, period string, price double, outlet_id string, category string"
ITEM_MONTHS = "item_id bigint, outlet_id string, category string, months array<string>"
MONTHS = "slice string, period string, items bigint, eligible bigint"
LINKS = "slice string, before string, period string, candidates bigint, matched_items bigint, link double"


def _part(item: str = "item_id") -> Column:
    return F.pmod(F.xxhash64(item), F.lit(PARTS)).cast("string")


def _slices(rows: DataFrame) -> DataFrame:
    """Each row once overall, and once for its category if it has one."""
    return rows.withColumn("slice", F.explode(F.array_compact(F.array(F.lit(basket.OVERALL), F.when(F.col("category") != basket.OVERALL, F.col("category"))))))


def _moved(old: DataFrame, new: DataFrame) -> DataFrame:
    """item_id, came and went (months), outlet_id and category of items that have a price in other months than before."""
    both = old.select("item_id", "period", F.lit(True).alias("_old")).join(
        new.select("item_id", "period", "outlet_id", "category", F.lit(True).alias("_new")), ["item_id", "period"], "full_outer"
    )
    changed = both.filter("_old is null or _new is null")
    return changed.groupBy("item_id").agg(
        F.collect_list(F.when(F.col("_new"), F.col("period"))).alias("came"), F.collect_list(F.when(F.col("_old"), F.col("period"))).alias("went"),
        F.max_by("outlet_id", F.when(F.col("_new"), F.col("period"))).alias("_outlet"), F.max_by("category", F.when(F.col("_new"), F.col("period"))).alias("_category"),
    )


def _counted(items: DataFrame, k: int) -> DataFrame:
    """How the counts of (slice, period) change with items' months, from `before` to `months`."""
    was, now = F.size("before") >= k, F.size("months") >= k
    each = lambda months, sign, eligible: F.transform(months, lambda m: F.struct(m.alias("period"), F.lit(sign).cast("long").alias("items"), F.when(eligible, sign).otherwise(0).cast("long").alias("eligible")))
    rows = items.select("category", F.explode(F.concat(each("before", -1, was), each("months", 1, now))).alias("r")).select("category", "r.*")
    return _slices(rows).groupBy("slice", "period").agg(F.sum("items").alias("items"), F.sum("eligible").alias("eligible"))


def _neighbours(months: DataFrame) -> DataFrame:
    """slice, before and period of each month in the basket and the one before it; slices of one month have none."""
    single = months.groupBy("slice").agg(F.count("*").alias("_n")).filter("_n = 1")
    ordered = basket.numbered(months.filter("eligible > 0").join(single, "slice", "left_anti").select("slice", "period"))
    return ordered.withColumn("before", F.lag("period").over(Window.partitionBy("slice").orderBy("ord"))).select("slice", "before", "period", "ord")


def _redone(prices: DataFrame, pairs: DataFrame, items: DataFrame | None, settings: Settings) -> DataFrame:
    """The judged pairs of prices of the given neighbours; items: those in the basket, if not all with two prices are.

    Between two neighbours an item of the basket has no month, so its price before is that of its last month read; rows of an item meet once, for all slices.
    """
    parts = max(prices.sparkSession.sparkContext.defaultParallelism, -(-prices.count() // ROWS_A_TASK))
    dealt = prices.select("item_id", "period", "price", "category").filter("price is not null").repartition(parts, "item_id")
    own = _slices(dealt if items is None else dealt.join(items, "item_id", "left_semi"))
    in_time = Window.partitionBy("slice", "item_id").orderBy(period_order(F.col("period")), "period")
    lagged = own.select("slice", "item_id", "period", "price").withColumns({"before": F.lag("period").over(in_time), "previous": F.lag("price").over(in_time)})
    return basket.judge(lagged.join(F.broadcast(pairs.select("slice", "before", "period")), ["slice", "before", "period"]), settings)


def replace_months(store: Store, rows: DataFrame, months: list[str], batch: str, settings: Settings = DEFAULTS) -> Snapshot:
    """The months hold these rows (item_id, period, price, outlet_id, category) from now on, and no others; one without rows is removed. One commit."""
    base, spark, k = store.snapshot(), store.spark, settings.min_periods_per_item
    if batch in base.batches:
        return base
    with run_folder(spark):
        given = rows.filter(F.col("item_id").isNotNull() & F.col("period").isin(*months))
        new = stored(
            spark,
            given.groupBy(F.col("item_id").cast("bigint").alias("item_id"), "period").agg(
                F.avg("price").alias("price"), F.max("outlet_id").alias("outlet_id"), F.max("category").alias("category")
            ),
            "prices"
        )
        moved = stored(spark, _moved(store.read("prices", PRICES, months, base), new), "moved")
        touched = [r[0] for r in moved.select(_part().alias("p")).distinct().collect()]  # PARTS at most
        known = store.read("item_months", ITEM_MONTHS, touched, base).join(moved, "item_id", "full_outer")
        none = F.array().cast("array<string>")
        after = F.array_sort(F.array_union(F.array_except(F.coalesce("months", none), F.coalesce("went", none)), F.coalesce("came", none)))
        items = known.select(
            "item_id", F.coalesce("_outlet", "outlet_id").alias("outlet_id"), F.coalesce("_category", "category").alias("category"),
            F.coalesce("months", none).alias("before"), after.alias("months"), F.col("came").isNotNull().alias("_moved")
        )
        items = stored(spark, items, "items")
        counts = store.read("months", MONTHS, at=base).unionByName(_counted(items.filter("_moved"), k))
        counts = stored(spark, counts.groupBy("slice", "period").agg(F.sum("items").alias("items"), F.sum("eligible").alias("eligible")).filter("items > 0"), "months")
        flipped = items.filter("_moved").filter((F.size("before") >= k) != (F.size("months") >= k)) if k > 2 else items.limit(0)
        entered = [r[0] for r in flipped.select(F.explode(F.array_union("before", "months"))).distinct().collect()]  # months

        pairs, links = _neighbours(counts).filter("before is not null"), store.read("links", LINKS, at=base)
        changed = F.col("period").isin(*months) | F.col("before").isin(*months) | (F.col("period").isin(*entered) & F.col("before").isin(*entered))
        fresh = pairs.join(
            store.read("pairs", "slice string, before string, period string", at=base), ["slice", "before", "period"], "left_anti"
        ).select("period").unionByName(pairs.filter(changed).select("period")).distinct()
        redo = stored(spark, pairs.join(F.broadcast(fresh), "period", "left_semi"), "pairs")
        ends = sorted({m for r in redo.select("before", "period").distinct().collect() for m in r})  # months, of neighbours of the replaced ones mostly
        prices = store.read("prices", PRICES, [m for m in ends if m not in months], base).unionByName(new.select("item_id", "period", "price", "outlet_id", "category"))
        eligible = None
        if k > 2:
            rest = store.read(
                "item_months", ITEM_MONTHS, [p for p in base.parts("item_months") if p not in touched], base
            ).select("item_id", "months").unionByName(items.select("item_id", "months"))
            eligible = rest.filter(F.size("months") >= k).select("item_id")
        judged = stored(spark, _redone(prices, redo, eligible, settings), "judged")
        sums = basket.link_sums(judged, "slice", "before", "period")
        kept = links.join(pairs.select("slice", "before", "period"), ["slice", "before", "period"], "left_semi").join(F.broadcast(fresh), "period", "left_anti")
        gone = [p for p in base.parts("excluded") if p not in {r[0] for r in pairs.select("period").distinct().collect()}]
        again = tuple({r[0] for r in fresh.collect()} | set(gone))
        return store.commit(base, batch, [
            Change("prices", new.select("item_id", "period", "price", "outlet_id", "category"), F.col("period"), tuple(months)),
            Change("item_months", items.filter(F.size("months") > 0).select("item_id", "outlet_id", "category", "months"), _part(), tuple(touched)),
            Change("months", counts.coalesce(1), F.lit("all")),
            Change("links", kept.unionByName(sums.select("slice", "before", "period", "candidates", "matched_items", "link")), F.lit("all")),
            Change("pairs", pairs.select("slice", "before", "period"), F.lit("all")),
            Change("excluded", basket.excluded_moves(judged, settings), F.col("period"), again),
        ])


def _gated(store: Store, at: Snapshot, settings: Settings) -> DataFrame:
    """The slices that are shown: overall, and categories with enough outlets and items."""
    items = store.read("item_months", ITEM_MONTHS, at=at)
    groups = items.filter("category is not null").groupBy(F.col("category").alias("slice")).agg(F.count_distinct("outlet_id").alias("_outlets"), F.count("*").alias("_items"))
    enough = groups.filter((F.col("_outlets") >= settings.min_outlets_per_category) & (F.col("_items") >= settings.min_items_per_category)).select("slice")
    return enough.unionByName(store.spark.createDataFrame([(basket.OVERALL,)], "slice string"))


def maintained_index(store: Store, settings: Settings = DEFAULTS, at: Snapshot | None = None) -> basket.Index:
    """Points, excluded moves and links as a full build over all prices gives them, from the stored sums."""
    at = store.snapshot() if at is None else at
    shown, months = _gated(store, at, settings), store.read("months", MONTHS, at=at)
    links = store.read("links", LINKS, at=at)
    ordered = _neighbours(months).join(F.broadcast(shown), "slice", "left_semi")
    linked = ordered.join(links.select("slice", "period", "candidates", "matched_items", "link"), ["slice", "period"], "left")
    single = months.groupBy("slice").agg(F.count("*").alias("_n"), F.min("period").alias("period")).filter("_n = 1").join(F.broadcast(shown), "slice", "left_semi").select("slice", "period")
    excluded = store.read("excluded", EXCLUDED, at=at).join(F.broadcast(shown), "slice", "left_semi")
    return basket.Index(basket.chain(linked, single, settings), excluded, linked.filter("candidates is not null").drop("before"))
