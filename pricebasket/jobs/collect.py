"""The monthly job: page snapshots to linked observations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebasket.functions.text import match_key, without_size
from pricebasket.operators.extract import page_items, page_texts
from pricebasket.operators.linking import KeyIndex, link_items
from pricebasket.operators.reports import outcome, parse_report, run_report
from pricebasket.operators.store import upsert_items, upsert_observations
from pricebasket.session import stored
from pricebasket.settings import DEFAULTS, Settings
from pricebasket.sources.outlets import only


@dataclass(frozen=True)
class Collected:
    items: DataFrame
    observations: DataFrame
    linked: DataFrame
    report: DataFrame
    pages: DataFrame
    log: DataFrame


def linkable(items: DataFrame) -> DataFrame:
    return items.withColumn("match_key", match_key(without_size(F.col("observed_name"))))


def collect(
    pages: DataFrame, outlets: DataFrame, items: DataFrame, observations: DataFrame, dataset: str, settings: Settings = DEFAULTS, ids: list[str] | None = None,
    index: KeyIndex | None = None
) -> Collected:
    """Pages of any number of months, linked to the stored items and merged with the stored observations.

    Pages are parsed once, and rows linked once: both are stored, and all that comes out reads from there. Pages may have the columns status (skipped or error: not read) and error (why); the log takes both over.
    """
    outlets = only(outlets, ids)
    own = pages.join(outlets.select(F.col("id").alias("outlet_id")), "outlet_id", "left_semi")
    given, error = (F.col(c) if c in pages.columns else F.lit(None).cast("string") for c in ("status", "error"))
    status = outcome(given, error, F.col("html"))
    texts = stored(pages.sparkSession, page_texts(own.filter(status == "fetched"), outlets, settings), "page-texts")
    found = linkable(page_items(texts, settings))
    linked = link_items(found, items, settings, index)
    place = ["outlet_id", "period", "position"]
    named = found.select("outlet_id", "period", F.col("position").cast("long").alias("position"), "observed_name", "price_cents")
    written = stored(pages.sparkSession, linked.join(named, place), "linked")
    scraped = own.groupBy("outlet_id", "period").agg(F.max("fetched_at").alias("scraped_at"))
    new = written.join(scraped, ["outlet_id", "period"]).select("item_id", "period", "price_cents", "observed_name", "scraped_at", F.lit(dataset).alias("dataset"), "position")
    seen = written.select("outlet_id", "match_key", "size_value", "size_unit", F.col("observed_name").alias("canonical_name"), "period")
    counts = found.groupBy("outlet_id", "period").agg(F.count("*").alias("items_found"))
    empty = F.coalesce(F.length("html"), F.lit(0)) == 0
    reason = F.when(status != "fetched", F.coalesce(error, F.when((status == "error") & empty, "empty page")))
    log = own.select(
        "outlet_id", "period", F.col("fetched_at").alias("ran_at"), status.alias("status"), reason.alias("reason")
    ).join(counts, ["outlet_id", "period"], "left").withColumn("items_found", F.coalesce("items_found", F.lit(0)).cast("int"))
    return Collected(upsert_items(items, seen), upsert_observations(observations, new), written, run_report(log, written)[0], parse_report(own, found, texts), log)
