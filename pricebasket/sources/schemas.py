"""Schemas of the stored tables and of their inputs."""

from __future__ import annotations

OUTLETS = "id string, name string, category string, url string"
ITEMS = "item_id bigint, outlet_id string, canonical_name string, match_key string, size_value double, size_unit string, first_seen string, last_seen string"
OBSERVATIONS = "item_id bigint, period string, price_cents bigint, observed_name string, scraped_at string, dataset string"
COLLECTION_LOG = "outlet_id string, ran_at string, status string, reason string, items_found int"
PAGES = "outlet_id string, period string, url string, html string, fetched_at string"
OUTLET_CONFIG = "id string, name string, category string, url string, renderer string, verified boolean, selectors struct<item:string,name:string,price:string>, notes string"
PARSED_ITEMS = "outlet_id string, period string, position int, name_text string, price_text string, used_fallback boolean"
POINTS = "slice string, period string, value double, matched_items bigint, link double, note string"
EXCLUDED = "slice string, period string, item_id bigint, `from` double, `to` double, change_pct double, reason string"
PAYLOAD = (
    "status string, responseTime bigint, message array<string>, Results struct<series:array<struct<seriesID:string,"
    "data:array<struct<year:string,period:string,periodName:string,latest:string,value:string,footnotes:array<struct<code:string,text:string>>>>>>>"
)
