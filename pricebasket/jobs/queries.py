"""Registered queries over the test tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebasket.functions import text
from pricebasket.functions.similarity import similarity
from pricebasket.jobs import maintained
from pricebasket.operators import basket, extract, linking, movers, permissions, reports, series, store
from pricebasket.session import new_path, stored
from pricebasket.sources import adapters, bucketed, constraints, outlets, payload, schemas, snapshots, tables

Query = Callable[[SparkSession, str], DataFrame]


def _points(df: DataFrame) -> DataFrame:
    return df.select("slice", "period", F.round("value", 6).alias("value"), "matched_items", F.round("link", 6).alias("link"), "note")


def index_overall(spark: SparkSession, d: str) -> DataFrame:
    return _points(basket.build_index(basket.overall_slice(adapters.priced(spark, d))).points)


def index_by_category(spark: SparkSession, d: str) -> DataFrame:
    return _points(basket.build_index(basket.category_slices(adapters.priced(spark, d))).points)


def index_maintained(spark: SparkSession, d: str) -> DataFrame:
    """The index from stored sums: built with one month wrong, one half empty and one missing, which are then replaced by the true ones."""
    rows, store = adapters.priced(spark, d).select("item_id", "period", "price", "outlet_id", "category"), snapshots.Store(spark, new_path(spark, "index"))
    period = F.col("period")
    wrong = rows.filter((period != "1998-05") & ((period != "1996-07") | (F.col("item_id") % 2 == 0))).withColumn(
        "price", F.when(period == "1997-03", F.col("price") * 2).otherwise(F.col("price"))
    )
    # of all lines: a month without rows is none
    months = sorted(r[0] for r in adapters.observations(spark, d, adapters.WILD).select("period").distinct().collect())
    maintained.replace_months(store, wrong, months, "whole")
    maintained.replace_months(store, rows, ["1996-07", "1997-03", "1998-05"], "mended")
    return _points(maintained.maintained_index(store).points)


def _published_summary(spark: SparkSession, d: str) -> DataFrame:
    points = basket.build_index(basket.all_slices(adapters.priced(spark, d))).points
    return basket.index_summary(basket.published_points(points))


def index_summary(spark: SparkSession, d: str) -> DataFrame:
    return _published_summary(spark, d).withColumns({c: F.round(c, 6) for c in ("latest_value", "total_change_pct")})


def category_summary(spark: SparkSession, d: str) -> DataFrame:
    described = adapters.table(spark, d, "region").select(F.col("r_name").alias("category"), F.concat(F.lit("Outlets of region "), "r_regionkey").alias("description"))
    return basket.category_summary(_published_summary(spark, d), described)


def index_links(spark: SparkSession, d: str) -> DataFrame:
    links = basket.build_index(basket.overall_slice(adapters.priced(spark, d, adapters.WILD))).links
    return links.select("period", "candidates", "matched_items", F.round("link", 6).alias("link"))


def excluded_moves(spark: SparkSession, d: str) -> DataFrame:
    out = basket.build_index(basket.overall_slice(adapters.priced(spark, d, adapters.WILD))).excluded
    return out.select("period", "item_id", F.round("from", 6).alias("from_price"), F.round("to", 6).alias("to_price"), F.round("change_pct", 6).alias("change_pct"), "reason")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return movers.item_price_changes(adapters.priced(spark, d).withColumn("price", text.dollars(F.col("price"))))


def item_price_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.priced(spark, d).withColumn("price", text.dollars(F.col("price")))
    out = movers.item_price_changes(rows, published=False)
    return out.withColumns({c: F.round(c, 6) for c in ("first_price", "last_price", "change_pct", "change_dollars")})


def price_movers_up(spark: SparkSession, d: str) -> DataFrame:
    return movers.increases(_changes(spark, d)).select("item_id", "change_pct")


def price_movers_down(spark: SparkSession, d: str) -> DataFrame:
    return movers.decreases(_changes(spark, d)).select("item_id", "change_pct")


def basket_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.basket_summary(adapters.priced(spark, d))


def joined_observations(spark: SparkSession, d: str) -> DataFrame:
    out = store.joined_observations(adapters.observations(spark, d), adapters.items(spark, d), adapters.outlets(spark, d), "real")
    return out.select("period", "item_id", "item", "outlet", "category", "price_cents", "price", "observed_name")


def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    return store.dataset_summary(adapters.observations(spark, d), adapters.items(spark, d), "simulated")


def datasets_available(spark: SparkSession, d: str) -> DataFrame:
    return store.available_datasets(adapters.observations(spark, d))


def recent_log(spark: SparkSession, d: str) -> DataFrame:
    return store.recent_log(adapters.collection_log(spark, d), adapters.outlets(spark, d)).select("outlet_id", "outlet", "ran_at", "status", "entry")


def _config(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id").cast("int")
    selectors = F.struct(F.lit(".i").alias("item"), F.when(k % 11 != 0, ".n").alias("name"), F.lit(".p").alias("price"))
    rows = adapters.outlets(spark, d).select(
        "id", "name", F.lower("category").alias("category"), "url", F.when(k % 5 == 0, "browser").when(k % 13 == 0, "paper").alias("renderer"),
        (k % 3 == 0).alias("verified"), selectors.alias("selectors")
    )
    return rows.unionByName(rows.filter(k % 17 == 0))


def outlet_violations(spark: SparkSession, d: str) -> DataFrame:
    return outlets.violations(_config(spark, d), categories=("africa", "america", "asia", "europe"))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    listed, whole = reports.coverage(_config(spark, d))
    return listed.groupBy("renderer", "verified").agg(F.count("*").alias("n")).join(F.broadcast(whole))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("item_id")
    return adapters.items(spark, d).select("outlet_id", (k % 3 == 0).alias("is_new"), (k % 5 == 0).alias("renamed"))


def run_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.run_report(adapters.collection_log(spark, d), _linked(spark, d))[1]


def run_totals(spark: SparkSession, d: str) -> DataFrame:
    return reports.run_report(adapters.collection_log(spark, d), _linked(spark, d))[0]


def page_outcomes(spark: SparkSession, d: str) -> DataFrame:
    k = F.length("url") + F.length("html")
    status, error = F.when(k % 7 == 0, "skipped").when(k % 11 == 0, "error"), F.when(k % 5 == 0, "timeout")
    pages = adapters.table(spark, d, "pages").select("page_id", status.alias("status"), error.alias("error"), F.when(k % 3 != 0, F.col("html")).alias("html"))
    return pages.select("page_id", reports.outcome(F.col("status"), F.col("error"), F.col("html")).alias("outcome"))


def known_items(spark: SparkSession, d: str) -> DataFrame:
    return store.known_items(adapters.items(spark, d), "3")


def restricted_run(spark: SparkSession, d: str) -> DataFrame:
    return outlets.only(adapters.outlets(spark, d), ["2", "3", "5", "7", "none such"])


def page_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Raw pages written as snapshots and read back."""
    path = new_path(spark, "pages")
    pages = adapters.table(spark, d, "pages").select(
        F.col("page_id").cast("string").alias("outlet_id"), F.lit("2024-01").alias("period"), "url", "html", F.lit("2024-01-05").alias("fetched_at")
    )
    pages.write.parquet(path)
    return tables.read_pages(spark, path).select("outlet_id", "period", "url", F.length("html").cast("long").alias("characters"), "fetched_at")


def replaced_months(spark: SparkSession, d: str) -> DataFrame:
    """Observations stored, those of one year stored again with other prices: only its months are replaced."""
    path = new_path(spark, "observations")
    rows = adapters.observations(spark, d).withColumn("position", F.expr("cast(order_key * 8 + position as int)"))
    whole = store.upsert_observations(tables.empty(spark, schemas.OBSERVATIONS), rows)
    tables.write_observations(whole, path)
    tables.write_observations(whole.filter("period like '1995-%'").withColumn("price_cents", F.col("price_cents") + 1), path)
    return tables.read_observations(spark, path, "real").select("item_id", "period", "price_cents", "observed_name", "scraped_at")


def appended_log(spark: SparkSession, d: str) -> DataFrame:
    """The collection log, and its errors appended once more."""
    path, log = new_path(spark, "log"), adapters.collection_log(spark, d)
    for part in (log, log.filter("status = 'error'")):
        tables.append_log(part, path)
    return tables.read_table(spark, path, schemas.COLLECTION_LOG).groupBy("outlet_id", "status").agg(F.count("*").alias("entries"), F.max("ran_at").alias("latest"))


# a tenth of a balance as text, cut from its integer cents, so that both engines read the same label
_CENTS = "cast(round(abs(c_acctbal) * 100) as bigint)"
_AMOUNT = f"concat(case when c_acctbal < 0 then '-' else '' end, cast(cast(floor({_CENTS} / 1000) as bigint) as varchar(20)), '.', lpad(cast(cast(floor({_CENTS} / 10) as bigint) % 100 as varchar(20)), 2, '0'))"
_LABELS = f"concat(c_mktsegment, '  ', case c_custkey % 5 when 0 then '$' when 1 then 'for ' when 2 then '' when 3 then '$ ' else '-' end, case when c_custkey % 9 = 0 then 'n/a' else {_AMOUNT} end)"


def parse_price(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.table(spark, d, "customer").select("c_custkey", F.expr(_LABELS.replace("varchar(20)", "string")).alias("t"))
    return rows.select("c_custkey", text.parse_price(F.col("t")).alias("cents"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("oz", "-Piece", " pounds", " liter", " count", "ml", " in", " blue", "LBS", " gram"))), F.pmod("p_partkey", F.lit(10)).cast("int") + 1)
    return adapters.table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" ("), "p_size", unit, F.lit(") or 8 oz")).alias("t"))


def split_size(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return _sized(spark, d).select("p_partkey", text.without_size(t).alias("rest"), text.size_value(t).alias("size_value"), text.size_unit(t).alias("size_unit"))


def match_key(spark: SparkSession, d: str) -> DataFrame:
    return adapters.table(spark, d, "part").select(
        "p_partkey", text.match_key(F.concat(F.lit("The "), "p_name", F.lit(" & Our "), "p_type", F.lit("!"))).alias("match_key"),
        text.match_key(F.lit("The House Special")).alias("filler")
    )


def clean_name(spark: SparkSession, d: str) -> DataFrame:
    return adapters.table(spark, d, "part").select(
        "p_partkey",
        text.clean_name(F.concat(F.lit(" - "), F.repeat(F.concat("p_name", F.lit("  · \t")), F.pmod("p_partkey", F.lit(12)).cast("int") + 1))).alias("name")
    )


def period_and_label(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.table(spark, d, "orders").select(
        "o_orderkey", text.period_of(F.col("o_orderdate")).alias("period"),
        text.category_label(F.lower(F.replace("o_orderpriority", F.lit("-"), F.lit("_")))).alias("label"), text.dollars(F.col("o_orderkey")).alias("dollars")
    )
    return rows.withColumn("ord", text.period_order(F.col("period")))


def item_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = adapters.items(spark, d).filter("item_id % 2 = 0").groupBy(*store.NATURAL).agg(
        F.min("item_id").alias("item_id"), F.min("canonical_name").alias("canonical_name"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen")
    )
    seen = adapters.items(spark, d).join(adapters.observations(spark, d).select("item_id", "period"), "item_id").drop("first_seen", "last_seen")
    out = store.upsert_items(old, seen.withColumn("canonical_name", F.col("match_key")))
    return out.select("outlet_id", "match_key", "size_value", "size_unit", "first_seen", "last_seen", F.col("item_id").between(0, 10_000_000_000).alias("was_known"))


def observation_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.observations(spark, d).withColumn("position", F.expr("cast(order_key * 8 + position as int)"))
    return store.upsert_observations(rows.filter("dataset = 'real'"), rows)


def dimension_sync(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.outlets(spark, d)
    return store.sync_outlets(rows, rows.filter("cast(id as int) % 2 = 0").withColumn("name", F.upper("name")))


def clear_dataset(spark: SparkSession, d: str) -> DataFrame:
    kept, items, removed = store.clear_dataset(adapters.observations(spark, d), adapters.items(spark, d), "simulated")
    left = kept.groupBy("item_id").agg(F.count("*").alias("observations"))
    return items.select("item_id").join(left, "item_id").join(F.broadcast(removed))


def series_flatten(spark: SparkSession, d: str) -> DataFrame:
    """The payload as a JSON file, read and flattened."""
    path = new_path(spark, "payload")
    adapters.payload(spark, d).write.json(path)
    return payload.flatten_series(payload.read_payload(spark, path), "SERIES").select("period", F.round("cpi", 6).alias("cpi"), "year", "month")


def _own(spark: SparkSession, d: str) -> DataFrame:
    return basket.build_index(basket.overall_slice(adapters.priced(spark, d))).points


def series_change(spark: SparkSession, d: str) -> DataFrame:
    months = adapters.observations(spark, d).select("period").distinct()
    out = series.change_over(adapters.official_series(spark, d), months).withColumn("span", F.lit("shared"))
    return out.unionByName(series.whole_change(adapters.official_series(spark, d)).withColumn("span", F.lit("whole"))).select(
        "span", "overlaps", "first_period", "last_period", F.round("change_pct", 6).alias("change_pct")
    )


def series_rebased(spark: SparkSession, d: str) -> DataFrame:
    return series.rebase(adapters.official_series(spark, d), "1996-01", "cpi").select("period", F.round("cpi", 6).alias("cpi"))


def comparison(spark: SparkSession, d: str) -> DataFrame:
    out = series.comparison(_own(spark, d), adapters.official_series(spark, d).filter("period >= '1995-03'"), "basket", "official")
    return out.select("period", F.round("value", 6).alias("value"), "series")


def headline_gap(spark: SparkSession, d: str) -> DataFrame:
    points = _own(spark, d)
    span = points.agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"))
    out = series.headline(basket.index_summary(basket.published_points(points)), series.change_over(adapters.official_series(spark, d), points), span)
    return out.select(*(F.round(c, 6).alias(c) for c in ("own_change_pct", "cpi_change_pct", "gap_points")), "verdict", "first_period", "last_period")


def joined_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """The joined observations, from tables that were written bucketed by item."""
    name = f"joined_{uuid.uuid4().hex}"
    bucketed.write_bucketed(adapters.observations(spark, d), f"{name}_observations", new_path(spark, "observations"), datasets=True)
    bucketed.write_bucketed(adapters.items(spark, d), f"{name}_items", new_path(spark, "items"))
    out = bucketed.joined_bucketed(spark, f"{name}_observations", f"{name}_items", adapters.outlets(spark, d), "real")
    return out.groupBy("period", "outlet", "category").agg(F.count("*").alias("n"), F.sum("price_cents").alias("cents"), F.min("item").alias("first_item"))


def broken_rules(spark: SparkSession, d: str) -> DataFrame:
    """What the raw observations are against, were they stored as they are: each rule with its rows, counted as they are written."""
    rows = adapters.observations(spark, d).withColumn("observed_name", F.when(F.col("position") != 7, F.col("observed_name")))
    rules = (*constraints.OBSERVATION_RULES, constraints.Rule("a price is under 1,500 dollars", holds="price_cents < 150000"))
    known = adapters.items(spark, d).filter("item_id % 10 != 3").select("item_id")
    rules = (*rules, constraints.referring("an observation's item is known", "item_id", known))
    return constraints.write_checked(rows, new_path(spark, "observations"), rules)


def page_items(spark: SparkSession, d: str) -> DataFrame:
    out = extract.page_items(extract.page_texts(*adapters.menu_pages(spark, d)))
    return out.select("outlet_id", "observed_name", "price_cents", "used_fallback")


def trailing_prices(spark: SparkSession, d: str) -> DataFrame:
    """Items whose price is the number after the name in one block's text."""
    out = extract.page_items(extract.page_texts(*adapters.plain_pages(spark, d, "p:has(b)")))
    return out.select("outlet_id", "observed_name", "price_cents", "used_fallback")


def swept_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of pages whose selector matches nothing, by the generic sweep."""
    out = extract.page_items(extract.page_texts(*adapters.plain_pages(spark, d, ".no-such")))
    return out.select("outlet_id", "observed_name", "price_cents", "used_fallback")


def parse_report(spark: SparkSession, d: str) -> DataFrame:
    pages, config = adapters.menu_pages(spark, d)
    texts = extract.page_texts(pages, config)
    return reports.parse_report(pages, extract.page_items(texts), texts).select("outlet_id", "items", "blocks_seen", "used_fallback", "notes")


def fragment_report(spark: SparkSession, d: str) -> DataFrame:
    """Items and notes of pages that are fragments, by the generic sweep."""
    pages, config = adapters.fragments(spark, d)
    texts = extract.page_texts(pages, config)
    found = extract.page_items(texts)
    report = reports.parse_report(pages, found, texts).select("outlet_id", "items", "blocks_seen", "used_fallback", "notes")
    return report.join(found.select("outlet_id", "observed_name", "price_cents"), "outlet_id", "left")


def sweep_report(spark: SparkSession, d: str) -> DataFrame:
    """The generic sweep over the raw pages, which have no selectors that fit."""
    pages = adapters.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("outlet_id"), F.lit("2024-01").alias("period"), "html")
    config = pages.select(F.col("outlet_id").alias("id"), F.struct(F.lit(".no-such").alias("item"), F.lit("a").alias("name"), F.lit("b").alias("price")).alias("selectors"))
    texts = extract.page_texts(pages, config)
    return reports.parse_report(pages, extract.page_items(texts), texts)


def _first(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The first month of each item that is observed, and as the earlier store the items of the first month of all."""
    items = adapters.items(spark, d)
    first = stored(spark, adapters.first_months(spark, d).join(items.select("item_id"), "item_id", "left_semi"), "first-months")
    known = first.join(F.broadcast(first.agg(F.min("period").alias("period"))), "period", "left_semi")
    return first, items.join(known, "item_id", "left_semi")


def _parsed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All items in the month they are first seen in, and the earlier store."""
    first, known = _first(spark, d)
    return first.join(adapters.items(spark, d), "item_id").withColumn("position", F.col("item_id")), known


def link_items(spark: SparkSession, d: str) -> DataFrame:
    return linking.link_items(*_parsed(spark, d)).select(
        "outlet_id", "size_value", "period", "position", "new_key", "match_key", F.round("score", 6).alias("score"), "is_new", "item_id"
    )


def _history(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every item in every month that it is observed in, and the earlier store."""
    items = adapters.items(spark, d).repartition(adapters.item_parts(spark, d), "item_id")
    return adapters.item_months(spark, d).join(items, "item_id").withColumn("position", F.col("item_id")), _first(spark, d)[1]


def link_history(spark: SparkSession, d: str) -> DataFrame:
    """Linking of whole months one after the other: known keys over again, new ones, and renamed ones in later months."""
    return linking.link_items(*_history(spark, d)).select("outlet_id", "size_value", "period", "position", "new_key", "match_key", F.round("score", 6).alias("score"), "is_new")


def history_renames(spark: SparkSession, d: str) -> DataFrame:
    return reports.renames(linking.link_items(*_history(spark, d))).groupBy("outlet_id", "old_key", "new_key", "score").agg(
        F.count("*").alias("months"), F.min("period").alias("first_period")
    )


def key_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The ratio of each item's key to that of the item after it and to its manufacturer's."""
    rows = adapters.table(spark, d, "part").select(
        "p_partkey", text.match_key(F.col("p_name")).alias("key"), text.match_key(F.concat("p_name", F.lit(" "), "p_brand")).alias("longer")
    )
    after = rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("key").alias("other"))
    joined = rows.join(after, "p_partkey")
    return joined.select("p_partkey", F.round(similarity(F.col("key"), F.col("other")), 6).alias("next"), F.round(similarity(F.col("other"), F.col("longer")), 6).alias("brand"))


def rename_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.renames(linking.link_items(*_parsed(spark, d)))


def permission_audit(spark: SparkSession, d: str) -> DataFrame:
    urls = adapters.table(spark, d, "pages").select("url")
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    kind = F.pmod(F.length("host"), F.lit(5))
    robots = urls.select(host.alias("host")).distinct().select(
        "host", F.when(kind == 0, 403).when(kind == 1, 404).otherwise(200).alias("status"),
        F.when(kind == 2, "User-agent: *\nDisallow: /en\nCrawl-delay: 10").when(kind == 3, "User-agent: *\nDisallow:").otherwise("User-agent: *\nDisallow: /").alias("body")
    )
    return permissions.permission_audit(urls, robots)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        index_overall, index_by_category, index_maintained, index_summary, category_summary, index_links, excluded_moves, item_price_changes,
        price_movers_up, price_movers_down, basket_summary, joined_observations, joined_bucketed, broken_rules, dataset_summary, datasets_available,
        recent_log, outlet_violations, coverage, run_report, run_totals, page_outcomes, known_items, restricted_run, page_snapshots,
        replaced_months, appended_log, parse_price, split_size, match_key, clean_name, period_and_label, item_upsert, observation_upsert,
        dimension_sync, clear_dataset, series_flatten, series_change, series_rebased, comparison, headline_gap, page_items, trailing_prices,
        swept_items, parse_report, fragment_report, sweep_report, link_items, link_history, history_renames, key_similarity, rename_report,
        permission_audit,
    )
}
