import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from pricebasket.functions.similarity import best_match, similarity
from pricebasket.jobs import monthly
from pricebasket.jobs.collect import collect
from pricebasket.operators import linking, permissions, store
from pricebasket.settings import Settings
from pricebasket.sources import outlets, payload, schemas, tables
from pricebasket.sources.snapshots import Store
from pricebasket.streaming.ingest import start_ingest

CONFIG = [("a", "A", "casual", "https://a.example", "static", True, (".menu-item", ".name a", ".price"), None), ("b", "B", "casual", "https://b.example", None, False, ("p:has(b)", "b", "::text_after_name"), None)]
HTML_A = "<div class='menu-item'><p class=name><a>Chowder (16 oz)</a><p><span class=price>$8.50</span></div>" * 2 + "<div class='menu-item'><p class=name><a>Classic Cheeseburger</a></p><i class=price>$12</i></div><div class='menu-item'><p class=name><a>No price</a></p></div>"
HTML_B = "<p><b>NAME</b> 14.5<p><b>Other</b> 3"
SWEEP = "<div><span>Gift card</span><span>$50</span></div><ul><li><b>Soup of the day</b> <i>$7.25</i></li></ul><script>$9.99</script>"


def config(spark, rows=CONFIG):
    return spark.createDataFrame(rows, schemas.OUTLET_CONFIG)


def pages(spark, rows):
    return spark.createDataFrame([(o, p, "u", h, f"{p}-01") for o, p, h in rows], schemas.PAGES)


def test_collect(spark):
    done = collect(pages(spark, [("a", "2026-01", HTML_A), ("b", "2026-01", HTML_B), ("a", "2026-02", SWEEP), ("b", "2026-02", "")]), config(spark), tables.empty(spark, schemas.ITEMS), tables.empty(spark, schemas.OBSERVATIONS), "real")
    got = {(r["period"], r["observed_name"], r["price_cents"]) for r in done.observations.collect()}
    assert got == {("2026-01", "Chowder (16 oz)", 850), ("2026-01", "Classic Cheeseburger", 1200), ("2026-01", "NAME", 1450), ("2026-01", "Other", 300), ("2026-02", "Soup of the day", 725)}
    report = {(r["outlet_id"], r["period"]): (r["items"], r["blocks_seen"], r["used_fallback"]) for r in done.pages.collect()}
    assert report == {("a", "2026-01"): (2, 4, False), ("b", "2026-01"): (2, 2, False), ("a", "2026-02"): (1, 0, True), ("b", "2026-02"): (0, 0, True)}
    assert {r["match_key"] for r in done.items.collect()} == {"chowder", "cheeseburger", "name", "other", "soup of day"}


def test_outcomes_reach_the_log(spark, tmp_path):
    """Skipped and failed pages give no items, and the log tells why; appended twice it holds both runs."""
    rows = [("a", "2026-01", HTML_A, None, None), ("b", "2026-01", HTML_B, "skipped", "robots.txt"), ("a", "2026-02", HTML_A, None, "timeout"), ("b", "2026-02", "", None, None), ("a", "2026-03", HTML_A, "error", None)]
    frame = spark.createDataFrame([(o, p, "u", h, f"{p}-01", s, e) for o, p, h, s, e in rows], schemas.PAGES + ", status string, error string")
    done = collect(frame, config(spark), tables.empty(spark, schemas.ITEMS), tables.empty(spark, schemas.OBSERVATIONS), "real")
    got = {(r["outlet_id"], r["period"]): (r["status"], r["reason"]) for r in done.log.collect()}
    assert got == {("a", "2026-01"): ("fetched", None), ("b", "2026-01"): ("skipped", "robots.txt"), ("a", "2026-02"): ("error", "timeout"), ("b", "2026-02"): ("error", "empty page"), ("a", "2026-03"): ("error", None)}
    report = done.report.first()
    assert (report["fetched"], report["skipped"], report["errored"]) == (1, 1, 3)
    for _ in range(2):
        tables.append_log(done.log, str(tmp_path / "log"))
    assert tables.read_table(spark, str(tmp_path / "log"), schemas.COLLECTION_LOG).count() == 10


def test_similarity_of_columns(spark):
    pairs = [("cheeseburger", "double cheeseburger"), ("a", ""), ("", ""), (None, "a"), ("soup", "soup"), ("soup of day", "soup du jour")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in frame.select(similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [None if a is None else SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs]


def test_linking_is_a_fold(spark):
    rows = [("a", None, None, "2026-01", 0, "cheeseburger"), ("a", None, None, "2026-01", 1, "cheeseburgers"), ("a", 12.0, "oz", "2026-01", 2, "cheeseburger"), ("a", None, None, "2026-02", 0, "double cheeseburger"), ("a", None, None, "2026-02", 1, "")]
    parsed = spark.createDataFrame(rows, "outlet_id string, size_value double, size_unit string, period string, position long, match_key string")
    for n in (1, 3):
        got = linking.link_items(parsed.repartition(n), tables.empty(spark, schemas.ITEMS)).orderBy("period", "position").collect()
        assert [(r["match_key"], r["is_new"], r["renamed"]) for r in got] == [("cheeseburger", True, False), ("cheeseburger", False, True), ("cheeseburger", True, False), ("double cheeseburger", True, False)]
        assert got[0]["item_id"] == got[1]["item_id"] != got[2]["item_id"]


def folded(rows, known, threshold):
    """Linking by the plain fold: every row against all keys of its bucket."""
    out = []
    for bucket in {r[:3] for r in rows}:
        keys = [k for _, k in sorted((first, key) for *b, key, first in known if tuple(b) == bucket)]
        for r in sorted((r for r in rows if r[:3] == bucket), key=lambda r: r[3:]):
            key, score = best_match(r[5], keys, threshold)
            out.append((*r, key or r[5], score if key else 1.0, key is None))
            keys += [] if key else [r[5]]
    return sorted(out, key=str)


@pytest.mark.parametrize(("threshold", "n"), [(0.88, 6), (0.5, 0)])
def test_linking_is_the_plain_fold(spark, threshold, n):
    """One bucket of keys a few letters apart, long and short ones, repeated over months, with and without stored keys."""
    r = random.Random(int(threshold * 100))
    stems = ["cheeseburger deluxe", "clam chowder", "fish and chips", "aa", "aaaaaaaa", "tea", "soup of day"]

    def key():
        letters = list(r.choice(stems))
        for _ in range(r.randrange(4)):
            letters[r.randrange(len(letters))] = r.choice(["", "x", "s", "a", "ab"])
        return "".join(letters) or "tea"

    buckets = [("a", None, None), ("a", 12.0, "oz"), ("b", None, None)]
    parsed = [(*buckets[r.choice([0, 0, 0, 1, 2])], f"2026-0{r.randint(1, 4)}", i, key()) for i in range(250)]
    columns = "outlet_id string, size_value double, size_unit string, period string, position long, match_key string"
    stored = {(b, key()) for b in buckets for _ in range(n)}
    known = [(*b, k, r.choice(["2025-01", "2025-02"])) for b, k in sorted(stored, key=str)]
    items = spark.createDataFrame(known, "outlet_id string, size_value double, size_unit string, match_key string, first_seen string")
    linked = linking.link_items(spark.createDataFrame(parsed, columns), items, Settings(match_threshold=threshold))
    got = linked.select("outlet_id", "size_value", "size_unit", "period", "position", "new_key", "match_key", "score", "is_new").collect()
    assert sorted(map(tuple, got), key=str) == folded(parsed, known, threshold)
    assert "CoGroups" not in linked._jdf.queryExecution().toString()


def test_datasets_stay_apart(spark, tmp_path):
    rows = [(1, "2026-01", c, "n", s, d) for c, s, d in ((1000, "1", "real"), (9999, "1", "simulated"))]
    frame = spark.createDataFrame(rows, schemas.OBSERVATIONS)
    new = spark.createDataFrame([(1, "2026-01", 1200, "n", "2", "real", 0)], schemas.OBSERVATIONS + ", position int")
    merged = store.upsert_observations(frame, new)
    path = str(tmp_path / "observations")
    tables.write_observations(frame, path)
    tables.write_observations(merged.filter("dataset = 'real'"), path)
    assert [r["price_cents"] for r in tables.read_observations(spark, path, "real").collect()] == [1200]
    assert [r["price_cents"] for r in tables.read_observations(spark, path, "simulated").collect()] == [9999]
    with pytest.raises(ValueError):
        tables.read_observations(spark, path, "")
    items = spark.createDataFrame([(1, "a", "n", "n", None, None, "x", "x"), (2, "a", "m", "m", None, None, "x", "x")], schemas.ITEMS)
    kept, left, removed = store.clear_dataset(frame, items, "simulated")
    assert (kept.count(), left.count(), removed.first()[0]) == (1, 1, 1)


def test_config_faults(spark):
    assert outlets.validated(config(spark)).filter("renderer = 'static'").count() == 2
    bad = [("a", "A", "fancy", "u", "odd", True, ("", "n", "p"), None)] * 2
    with pytest.raises(ValueError, match="repeated id"):
        outlets.validated(config(spark, bad))
    with pytest.raises(ValueError, match="no outlets"):
        outlets.validated(config(spark, []))
    with pytest.raises(ValueError):
        outlets.only(config(spark), ["zzz"])


def test_payload(spark, tmp_path):
    entry = lambda y, p, v: {"year": y, "period": p, "value": v}
    (tmp_path / "p.json").write_text(json.dumps({"status": "REQUEST_SUCCEEDED", "Results": {"series": [{"seriesID": "S", "data": [entry("2024", "M02", "2.5"), entry("2024", "M01", "2"), entry("2024", "M13", "9"), entry("2025", "M10", "-")]}]}}, indent=1))
    frame = payload.read_payload(spark, str(tmp_path / "p.json"))
    assert [(r["period"], r["cpi"]) for r in payload.read_series(frame, "S").collect()] == [("2024-01", 2.0), ("2024-02", 2.5)]
    with pytest.raises(ValueError):
        payload.read_series(frame, "T")
    with pytest.raises(ValueError):
        payload.read_series(frame.withColumn("status", F.lit("REQUEST_FAILED")), "S")


def test_permissions(spark):
    urls = spark.createDataFrame([(f"https://{h}/x",) for h in "abcdef"], "url string")
    robots = spark.createDataFrame([("a", 200, "User-agent: *\nDisallow: /x"), ("b", 200, "User-agent: *\nDisallow:\nCrawl-delay: 10"), ("c", 403, None), ("d", 404, None), ("e", None, None)], "host string, status int, body string")
    got = {r["host"]: (r["allowed"], r["reason"]) for r in permissions.permission_audit(urls, robots).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": False, "b": True, "c": False, "d": True, "e": False, "f": False}
    assert "10" in got["b"][1]


def test_stream(spark, tmp_path):
    where = [str(tmp_path / x) for x in ("pages", "store", "checkpoint")]
    for month in ("2026-01", "2026-02"):
        pages(spark, [("a", month, HTML_A)]).write.mode("append").parquet(where[0])
        start_ingest(spark, where[0], config(spark), *where[1:], "real").awaitTermination()
    store = Store(spark, where[1])
    assert store.read("observations", schemas.OBSERVATIONS).filter("dataset = 'real'").count() == 4
    assert monthly.read_log(store).groupBy("status").sum("items_found").collect()[0][1] == 4
    assert store.read("items", schemas.ITEMS).filter("first_seen = '2026-01' and last_seen = '2026-02'").count() == 2
