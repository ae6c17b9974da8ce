"""The registered queries as SQL over the same tables."""

from __future__ import annotations

from pricebasket.functions.text import EDGES, FILLER_WORDS, UNITS
from pricebasket.jobs.queries import _LABELS
from pricebasket.sources.adapters import CALM, WILD

FILLER = ", ".join(f"'{w}'" for w in FILLER_WORDS)


def _key(name: str) -> str:
    words = f"list_filter(regexp_split_to_array(regexp_replace(replace(lower({name}), '&', ' and '), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"
    return f"array_to_string(case when len(list_filter({words}, lambda w: w not in ({FILLER}))) > 0 then list_filter({words}, lambda w: w not in ({FILLER})) else {words} end, ' ')"


OUTLETS = """outlet as (select cast(s_suppkey as varchar) id, s_name as name, r_name category, 'https://outlet' || s_suppkey || '.example.com/menu' url
   from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
ITEMS = f"""item as (select p_partkey item_id, cast(p_partkey % (select count(*) from supplier) as varchar) outlet_id, p_name canonical_name,
   {_key('p_name')} match_key, cast(p_size % 3 as double) size_value, 'oz' size_unit from part)"""


def _observed(price: str) -> str:
    return f"""obs as (select l_partkey item_id, strftime(l_shipdate, '%Y-%m') period, cast(round(({price}) * 100) as bigint) price_cents, strftime(l_shipdate,
   '%Y-%m-%d') scraped_at, case when l_linestatus = 'F' then 'real' else 'simulated' end dataset, l_orderkey || '-' || l_linenumber observed_name,
   l_orderkey, l_linenumber from lineitem join part on l_partkey = p_partkey)"""


def _priced(price: str) -> str:
    return f"""{OUTLETS}, {ITEMS}, {_observed(price)}, priced as (select obs.item_id, period, price_cents price, canonical_name item, outlet_id, outlet.name outlet,
   category from obs join item using (item_id) join outlet on outlet_id = outlet.id)"""


# Sums of cents are exact integers wherever a month's readings are; means go through doubles on both sides.
CHAIN = """
 one as (select slice, item_id, period, avg(price) price from sliced group by all),
 elig as (select * from (select *, count(*) over (partition by slice, item_id) n from one) where n >= 2),
 per as (select slice, period, row_number() over (partition by slice order by period) ord from (select distinct slice, period from elig)),
 lagged as (select e.*, p.ord, lag(e.price) over w prev, lag(p.ord) over w prev_ord from elig e join per p using (slice, period)
   window w as (partition by e.slice, e.item_id order by p.ord)),
 pairs as (select *, (price / prev - 1) * 100 change_pct, abs((price / prev - 1) * 100) > 60 bad from lagged where prev_ord = ord - 1),
 links as (select slice, ord, count(*) candidates, count(*) filter (not bad) matched_items,
   sum(price) filter (not bad) / nullif(sum(prev) filter (not bad), 0) link from pairs group by all),
 points as (select per.slice, per.period, per.ord, 100 * product(coalesce(link, 1.0)) over (partition by per.slice
   order by per.ord) as value, coalesce(matched_items, 0) matched_items, coalesce(link, 1.0) link,
   case when per.ord = 1 then 'base period' when candidates is null then 'no items priced in both months; index carried forward' when matched_items =
     0 then 'every matched item was excluded as implausible' else '' end note
   from per left join links on links.slice = per.slice and links.ord = per.ord)"""
OVERALL = "sliced as (select 'overall' slice, * from priced)"
GATED = "enough as (select category from priced group by category having count(distinct outlet_id) >= 2 and count(distinct item_id) >= 3)"
BY_CATEGORY = f"{GATED}, sliced as (select category slice, priced.* from priced join enough using (category))"
POINTS = 'select slice, period, round("value", 6) as "value", cast(matched_items as bigint) matched_items, round(link, 6) link, note from points'
CPI = """totals as (select strftime(o_orderdate, '%Y-%m') period, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) cents, count(*) n from orders
   group by all), cpi as (select period, cents / (n * 100.0::double) cpi from totals)"""
CONFIG = """config0 as (select id, name, lower(category) category,
   case when id::int % 5 = 0 then 'browser' when id::int % 13 = 0 then 'paper' end renderer, id::int % 3 = 0 verified,
   case when id::int % 11 <> 0 then '.n' end name_selector from outlet),
 config as (select * from config0 union all select * from config0 where id::int % 17 = 0)"""
SUMMARY = 'summary as (select slice, count(*) points, max_by(period, ord) latest_period, max_by("value", ord) latest_value, case when count(*) > 1 then (max_by("value", ord) / nullif(min_by("value", ord), 0) - 1) * 100 end total_change_pct from published group by slice)'
PUBLISHED = 'published as (select slice, period, ord, round("value", 2) as "value" from points)'
LOG = """log as (select cast(o_custkey % (select count(*) from supplier) as varchar) outlet_id, strftime(o_orderdate, '%Y-%m-%d') ran_at,
   case o_orderstatus when 'F' then 'fetched' when 'O' then 'skipped' else 'error' end status, o_orderkey entry from orders)"""
# exact cents of an item and month, so that both engines divide the same integers
MOVES = f"""with {_priced(CALM)}, one as (select item_id, period, avg(price / 100.0::double) price, min(item) item, min(outlet) outlet,
   min(category) category from priced group by all),
 moves as (select item_id, min(item) item, min(outlet) outlet, min(category) category, min(period) first_period, max(period) last_period,
   min_by(price, period) first_price, max_by(price, period) last_price, round((max_by(price, period) / min_by(price, period) - 1) * 100, 1) change_pct
 from one group by item_id having count(*) > 1 and min_by(price, period) > 0)"""
PLACE = "(?:^|[^\\d.])((\\d+(?:\\.\\d+)?)\\s*[-\\s]?\\s*(oz|ounces?|lbs?|pounds?|pcs?|pieces?|ct|count|inch|in|g|grams?|ml|l))\\b"
UNIT_MAP = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in UNITS.items()) + "}"
SIZED = """sized as (select p_partkey, p_name || ' (' || p_size || ['oz', '-Piece', ' pounds', ' liter', ' count', 'ml', ' in', ' blue', 'LBS',
   ' gram'][p_partkey % 10 + 1] || ') or 8 oz' t from part)"""

SUMMARIES = f"""with {_priced(CALM)}, {GATED}, sliced as (select 'overall' slice, * from priced union all select category slice, * from priced
   where category in (select category from enough)), {CHAIN}, {PUBLISHED}, {SUMMARY}"""
LAST = """last as (select * from (select *, row_number() over (partition by item_id, period, dataset
   order by scraped_at desc, l_orderkey * 8 + l_linenumber desc, price_cents desc, observed_name desc) nth from obs) where nth = 1)"""
REPORT = """linked as (select outlet_id, count(*) items_written, count(*) filter (item_id % 3 = 0) new_items, count(*) filter (item_id % 5 = 0) renames from item
   group by 1), report as (select outlet_id, count(*) filter (status = 'fetched') fetched, count(*) filter (status = 'skipped') skipped,
   count(*) filter (status = 'error') errored from log group by outlet_id)"""

SQL = {
    "index_overall": f"with {_priced(CALM)}, {OVERALL}, {CHAIN} {POINTS}",
    "index_by_category": f"with {_priced(CALM)}, {BY_CATEGORY}, {CHAIN} {POINTS}",
    "index_summary": f"{SUMMARIES} select slice, points, latest_period, round(latest_value, 6) latest_value, round(total_change_pct, 6) total_change_pct from summary",
    "category_summary": f"""{SUMMARIES} select slice, upper(slice[1]) || lower(replace(slice[2:], '_', ' ')) as label, 'Outlets of region ' || r_regionkey description,
   round(coalesce(total_change_pct, 0), 2) change_pct, latest_value from summary left join region on r_name = slice""",
    "index_links": f"with {_priced(WILD)}, {OVERALL}, {CHAIN} select period, candidates, matched_items, round(link, 6) link from links join per using (slice, ord)",
    "excluded_moves": f"""with {_priced(WILD)}, {OVERALL}, {CHAIN} select period, item_id, round(prev, 6) from_price, round(price, 6) to_price, round(change_pct, 6) change_pct,
   'move above the 60% plausibility limit' reason from pairs where bad""",
    "item_price_changes": f"""{MOVES} select item_id, item, outlet, category, first_period, last_period, round(first_price, 6) first_price, round(last_price, 6) last_price,
   round((last_price / first_price - 1) * 100, 6) + 0.0::double change_pct, round(last_price - first_price, 6) + 0.0::double change_dollars from moves""",
    "price_movers_up": f"{MOVES} select item_id, change_pct from moves where change_pct > 0 order by change_pct desc, item_id limit 15",
    "price_movers_down": f"{MOVES} select item_id, change_pct from moves where change_pct < 0 order by change_pct, item_id limit 15",
    "basket_summary": f"""with {_priced(CALM)}, each as (select item_id, count(distinct period) seen_in, min(outlet_id) outlet_id, count(*) n from priced
   group by item_id) select count(*) total_items, count(*) filter (seen_in >= 2) basket_items, count(distinct outlet_id) outlets,
   cast(sum(n) as bigint) observations, median(seen_in) median_periods, (select count(distinct period) from priced) periods from each""",
    "joined_observations": f"""with {OUTLETS}, {ITEMS}, {_observed(CALM)} select period, obs.item_id, canonical_name item, outlet.name outlet, category, price_cents,
   price_cents / 100.0::double price, observed_name from obs join item using (item_id) join outlet on outlet_id = outlet.id where dataset = 'real'""",
    "dataset_summary": f"""with {ITEMS}, {_observed(CALM)} select count(*) observations, count(distinct obs.item_id) items, count(distinct outlet_id) outlets,
   count(distinct period) periods, min(period) first_period, max(period) last_period from obs join item using (item_id) where dataset = 'simulated'""",
    "datasets_available": f"with {_observed(CALM)} select distinct dataset from obs",
    "recent_log": f"""with {OUTLETS}, {LOG} select outlet_id, outlet.name outlet, ran_at, status, entry from (select * from log
   order by ran_at desc, outlet_id, entry limit 60) left join outlet on outlet_id = outlet.id""",
    "outlet_violations": f"""with {OUTLETS}, {CONFIG} select id, 'unknown category ' || coalesce(category, 'null') problem from config
   where coalesce(category not in ('africa', 'america', 'asia', 'europe'), true) union all select id, 'unknown renderer ' || renderer from config
   where renderer not in ('static', 'browser') union all select id, 'no selector for name' from config where name_selector is null
   union all select id, 'repeated id' from config group by id having count(*) > 1""",
    "coverage": f"""with {OUTLETS}, {CONFIG} select coalesce(renderer, 'static') renderer, verified, count(*) n, (select count(*) from config
   where not verified) unverified, (select count(*) from config) total from config group by 1, 2""",
    "run_report": f"""with {ITEMS}, {LOG}, {REPORT} select outlet_id, fetched, skipped, errored, coalesce(items_written, 0) items_written, coalesce(new_items, 0) new_items,
   coalesce(renames, 0) renames from report left join linked using (outlet_id)""",
    "run_totals": f"with {ITEMS}, {LOG}, {REPORT}, t as (select cast(sum(fetched) as bigint) fetched, cast(sum(skipped) as bigint) skipped, cast(sum(errored) as bigint) errored, cast(coalesce(sum(items_written), 0) as bigint) items_written, cast(coalesce(sum(new_items), 0) as bigint) new_items, cast(coalesce(sum(renames), 0) as bigint) renames from report left join linked using (outlet_id)) select *, fetched || ' fetched, ' || skipped || ' skipped, ' || errored || ' errors, ' || items_written || ' items written, ' || new_items || ' new' as \"summary\" from t",
    "page_outcomes": """with k as (select page_id, html, length(url) + length(html) k from pages) select page_id,
   case when k % 7 = 0 then 'skipped' when k % 11 = 0 or k % 5 = 0 or k % 3 = 0 or html = '' then 'error' else 'fetched' end outcome from k""",
    "known_items": f"with {ITEMS} select item_id, match_key, size_value, size_unit, canonical_name from item where outlet_id = '3'",
    "restricted_run": f"with {OUTLETS} select id, name, category, url from outlet where id in ('2', '3', '5', '7')",
    "page_snapshots": "select cast(page_id as varchar) outlet_id, '2024-01' period, url, length(html) characters, '2024-01-05' fetched_at from pages",
    "replaced_months": f"""with {_observed(CALM)}, {LAST} select item_id, period, price_cents + case when period like '1995-%' then 1 else 0 end price_cents, observed_name,
   scraped_at from last where dataset = 'real'""",
    "appended_log": f"with {LOG} select outlet_id, status, sum(case when status = 'error' then 2 else 1 end)::bigint entries, max(ran_at) latest from log group by all",
    "parse_price": f"with labels as (select c_custkey, {_LABELS} t from customer), found as (select c_custkey, try_cast(nullif(regexp_extract(replace(t, ',', ''), '\\$?\\s*(\\d+(?:\\.\\d{{1,2}})?)', 1), '') as decimal(20, 2)) v from labels) select c_custkey, case when v between 0.75 and 250 then cast(v * 100 as bigint) end cents from found",
    "split_size": f"""with {SIZED}, found as (select *, regexp_extract(t, '{PLACE}', 1, 'i') whole, regexp_extract(t, '{PLACE}', 2, 'i') v, regexp_extract(t, '{PLACE}', 3,
   'i') u from sized) select p_partkey, case when whole = '' then t else t[: strpos(t, whole) - 1] || t[strpos(t, whole) + length(whole) :] end rest,
   try_cast(nullif(v, '') as double) size_value, ({UNIT_MAP})[lower(u)] size_unit from found""",
    "match_key": f"select p_partkey, {_key("'The ' || p_name || ' & Our ' || p_type || '!'")} match_key, 'the house special' as \"filler\" from part",
    "clean_name": f"select p_partkey, trim(regexp_replace(' - ' || repeat(p_name || '  · ' || chr(9), cast(p_partkey % 12 + 1 as int)), '\\s+', ' ', 'g'), '{EDGES[:-2]}' || chr(9) || chr(10))[:120] as name from part",
    "period_and_label": """select o_orderkey, strftime(o_orderdate, '%Y-%m') period, upper(replace(o_orderpriority, '-', ' ')[1]) || lower(replace(o_orderpriority, '-',
   ' ')[2:]) as label, o_orderkey / 100.0::double dollars, cast(year(o_orderdate) * 12 + month(o_orderdate) as int) ord from orders""",
    "item_upsert": f"""with {ITEMS}, {_observed(CALM)}, old as (select outlet_id, match_key, size_value, size_unit from item where item_id % 2 = 0 group by all),
   seen as (select outlet_id, match_key, size_value, size_unit, min(period) a, max(period) b from obs join item using (item_id)
   group by all) select coalesce(old.outlet_id, seen.outlet_id) outlet_id, coalesce(old.match_key, seen.match_key) match_key, coalesce(old.size_value,
   seen.size_value) size_value, coalesce(old.size_unit, seen.size_unit) size_unit, least(case when old.outlet_id is not null then '1995-01' end,
   a) first_seen, greatest(case when old.outlet_id is not null then '1995-01' end, b) last_seen, old.outlet_id is not null was_known from old full
   join seen on old.outlet_id = seen.outlet_id and old.match_key = seen.match_key and old.size_value = seen.size_value and old.size_unit = seen.size_unit""",
    "observation_upsert": f"with {_observed(CALM)}, {LAST} select item_id, period, dataset, price_cents, observed_name, scraped_at from last",
    "dimension_sync": f"with {OUTLETS} select id, case when id::int % 2 = 0 then upper(name) else name end as name, category, url from outlet",
    "clear_dataset": f"""with {ITEMS}, {_observed(CALM)} select item_id, count(*) observations, (select count(*) from obs where dataset = 'simulated') removed from obs
   join item using (item_id) where dataset <> 'simulated' group by item_id""",
    "series_flatten": f"with {CPI} select period, round(cpi, 6) cpi, period[1:4]::int as \"year\", period[6:7]::int as \"month\" from cpi",
    "series_change": f"with {CPI}, m as (select distinct strftime(l_shipdate, '%Y-%m') period from lineitem), both_spans as (select 'shared' span, cpi.* from cpi join m using (period) union all select 'whole', cpi.* from cpi) select span, count(*) as \"overlaps\", min(period) first_period, max(period) last_period, round((max_by(cpi, period) / min_by(cpi, period) - 1) * 100, 6) change_pct from both_spans group by span",
    "series_rebased": f"with {CPI} select period, round(cpi / (select b.cpi from cpi b where b.period = '1996-01') * 100, 6) cpi from cpi",
    "comparison": f"with {_priced(CALM)}, {OVERALL}, {CHAIN}, {CPI}, shared as (select cpi.* from cpi where period >= '1995-03' and period in (select period from points)) select period, round(\"value\", 6) as \"value\", 'basket' series from points union all select period, round(cpi / (select min_by(cpi, period) from shared) * 100, 6), 'official' from shared",
    "headline_gap": f"""with {_priced(CALM)}, {OVERALL}, {CHAIN}, {PUBLISHED}, {SUMMARY}, {CPI}, c as (select (max_by(cpi, period) / min_by(cpi, period) - 1) * 100 x from cpi
   where period in (select period from points)) select round(total_change_pct, 6) own_change_pct, round(x, 6) cpi_change_pct, round(total_change_pct - x,
   6) gap_points, case when total_change_pct > x then 'faster than' else 'slower than' end verdict, (select min(period)
   from points) first_period, (select max(period) from points) last_period from summary, c""",
    "page_items": """select cast(p_partkey // 50 as varchar) outlet_id, p_name || ' No ' || p_partkey observed_name,
   cast(100 + p_partkey % 200 * 25 as bigint) price_cents, false used_fallback from part where p_partkey % 7 <> 0""",
    "trailing_prices": """select cast(p_partkey // 50 as varchar) outlet_id, p_name || ' No. ' || p_partkey || 'x' observed_name,
   cast(100 + p_partkey % 200 * 25 as bigint) price_cents, false used_fallback from part where p_partkey % 7 <> 0""",
    "swept_items": """select cast(p_partkey // 50 as varchar) outlet_id, p_name || ' No. ' || p_partkey || 'x' observed_name,
   cast(100 + p_partkey % 200 * 25 as bigint) price_cents, true used_fallback from part where p_partkey % 7 <> 0""",
    "parse_report": """select cast(p_partkey // 50 as varchar) outlet_id, count(*) filter (p_partkey % 7 <> 0) items, cast(2 * count(*) as int) blocks_seen, false used_fallback,
          count(*) filter (p_partkey % 7 <> 0) || ' items from ' || 2 * count(*) || ' blocks' notes from part group by 1""",
    "fragment_report": """select cast(p_partkey as varchar) outlet_id, cast(1 as bigint) items, cast(0 as int) blocks_seen, true used_fallback,
          'selector ''.no-such'' matched nothing; generic sweep found 1 items' notes, p_name || ' No. ' || p_partkey || 'x' observed_name,
          cast(100 + p_partkey % 200 * 25 as bigint) price_cents from part""",
    "permission_audit": """with asked as (select distinct url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) host from pages),
   k as (select *, length(host) % 5 kind, regexp_extract(url, '^[a-z]+://[^/?#]+(/[^#]*)?', 1) as path from asked)
        select url, host, cast(case kind when 0 then 403 when 1 then 404 else 200 end as int) status, kind in (1, 3) or (kind = 2 and not starts_with(path, '/en')) allowed,
          case when kind = 0 then 'robots.txt could not be read; refusing' when kind in (1,
   3) then 'allowed by robots.txt' when kind = 2 and not starts_with(path,
   '/en') then 'allowed; crawl delay of 10 s' else 'disallowed by robots.txt' end reason from k""",
}
SQL["index_maintained"] = f"select * from ({SQL['index_overall']}) union all select * from ({SQL['index_by_category']})"
SQL["joined_bucketed"] = f"""with {OUTLETS}, {ITEMS}, {_observed(CALM)}
 select period, outlet.name outlet, category, count(*) n, cast(sum(price_cents) as bigint) cents, min(canonical_name) first_item
 from obs join item using (item_id) join outlet on outlet_id = outlet.id where dataset = 'real' group by all"""
SQL["broken_rules"] = f"""with {_observed(CALM)}, found as (
 select 'item, month, price, name, time and dataset are there' as rule, count(*) filter (l_linenumber = 7) as rows from lineitem
 union all select 'an item has one price a month and dataset', count(*) - count(distinct (item_id, period, dataset)) from obs
 union all select 'a price is under 1,500 dollars', count(*) filter (price_cents >= 150000) from obs
 union all select 'an observation''s item is known', count(*) filter (item_id % 10 = 3) from obs)
 select rule, cast(rows as bigint) as rows from found where rows > 0"""


# The ratio of two strings: the longest common run, the earliest of equal ones, and so on to its left and right.
BEST = """list_max(flatten([[struct_pack(l := coalesce(list_max([k for k in range(1, least(length(a) - i + 1, length(b) - j + 1) + 1)
   if substr(a, i, k) = substr(b, j, k)]), 0), i := -i, j := -j) for j in range(1, length(b) + 1)] for i in range(1, length(a) + 1)]))"""
RATIO = f"""seg as (
   select a as pa, b as pb, a, b from pairs
   union all
   select pa, pb, unnest([substr(a, 1, -best.i - 1), substr(a, -best.i + best.l)]), unnest([substr(b, 1, -best.j - 1), substr(b, -best.j + best.l)])
   from (select *, {BEST} as best from seg) where best.l > 0),
 ratio as (
   select pa as a, pb as b, case when length(pa) > 0 and length(pb) > 0 then 2.0::double * coalesce(sum(l), 0) / (length(pa) + length(pb)) else 0 end as score
   from (select pa, pb, ({BEST}).l as l from seg) group by pa, pb)"""
MONTHS, FIRST_MONTHS = "select distinct item_id, period from obs", "select item_id, min(period) as period from obs group by item_id"


def _history(months: str) -> str:
    return f"""{ITEMS}, {_observed(CALM)},
 row as (select distinct outlet_id, size_value, period, item_id as position, match_key as k from ({months}) join item using (item_id) where match_key <> ''),
 old as (select distinct outlet_id, size_value, match_key as k from item where item_id in (select item_id from obs where period = (select min(period) from obs))),
 new as (select outlet_id, size_value, k, min(period || '#' || lpad(cast(position as varchar), 20, '0')) as since from row anti
   join old using (outlet_id, size_value, k) group by all),
 pairs as (
   select distinct n.k as a, o.k as b from new n join (select outlet_id, size_value, k from new union all from old) o using (outlet_id, size_value)
   where n.k <> o.k and 2.0 * least(length(n.k), length(o.k)) >= 0.88 * (length(n.k) + length(o.k)))"""
LINKED = f"""{RATIO},
 near as (select a, list(b) as near from ratio where score >= 0.88 group by a),
 turn as (select outlet_id, size_value, k, since, row_number() over (partition by outlet_id, size_value order by since) as n from new),
 fold as (
   select outlet_id, size_value, cast(0 as bigint) as n, coalesce(list(o.k) filter (o.k is not null), []) as founders
   from (select distinct outlet_id, size_value from turn) left join old o using (outlet_id, size_value) group by all
   union all
   select outlet_id, size_value, t.n, case when len(list_intersect(founders, coalesce(near, []))) > 0 then founders else list_append(founders, t.k) end
   from fold f join turn t using (outlet_id, size_value) left join near on near.a = t.k where t.n = f.n + 1),
 founder as (
   select distinct outlet_id, size_value, k, cast(null as varchar) as since from old
   union all
   select t.outlet_id, t.size_value, t.k, t.since from turn t join fold f using (outlet_id, size_value)
   where f.n = (select max(n) from turn x where x.outlet_id = t.outlet_id and x.size_value = t.size_value) and list_contains(founders, t.k)),
 choice as (
   select r.*, f.k as found, case when f.k = r.k then 1.0 else score end as score, f.since,
          row_number() over (partition by r.outlet_id, r.size_value, r.period, r.position order by (f.k = r.k) desc, score desc, f.since is not null, f.since, f.k) as best
   from row r join founder f using (outlet_id, size_value) left join ratio on ratio.a = r.k and ratio.b = f.k
   where f.k = r.k or (score >= 0.88 and (f.since is null or f.since < r.period || '#' || lpad(cast(r.position as varchar), 20, '0'))))
 """
SQL["link_history"] = f"""with recursive {_history(MONTHS)}, {LINKED}
 select outlet_id, size_value, period, position, k as new_key, found as match_key, round(score, 6) as score,
   coalesce(since = period || '#' || lpad(cast(position as varchar), 20, '0'), false) as is_new from choice where best = 1"""
SQL["history_renames"] = f"""with recursive {_history(MONTHS)}, {LINKED}
 select outlet_id, found as old_key, k as new_key, round(score, 3) as score, count(*) as months, min(period) as first_period from choice
   where best = 1 and found <> k group by all"""
SQL["key_similarity"] = f"""with recursive keyed as (
   select p_partkey, {_key('p_name')} as key, {_key("p_name || ' ' || p_brand")} as longer, lead({_key('p_name')}) over (order by p_partkey) as other from part),
 pairs as (select distinct key as a, other as b from keyed where other is not null union select distinct other, longer from keyed where other is not null),
 {RATIO}
 select p_partkey, round(x.score, 6) as next, round(y.score, 6) as brand
 from keyed join ratio x on x.a = key and x.b = other join ratio y on y.a = other and y.b = longer"""
SQL["rename_report"] = f"""with recursive {_history(FIRST_MONTHS)}, {LINKED}
 select outlet_id, period, found as old_key, k as new_key, round(score, 3) as score from choice where best = 1 and found <> k"""
