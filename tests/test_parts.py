"""What a task holds does not grow with the tables: rows are dealt by item into parts whose number follows theirs."""

import re

import pytest
from pyspark.sql import functions as F

from pricebasket.jobs import maintained
from pricebasket.jobs.queries import QUERIES
from pricebasket.operators import basket, linking
from pricebasket.settings import DEFAULTS
from pricebasket.sources import adapters

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(adapters, "ROWS_A_TASK", 100)
    rows = adapters.priced(spark, SMALL)
    assert rows.rdd.getNumPartitions() == -(-rows.count() // 100)
    assert rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1000
    assert rows.select("item_id", F.spark_partition_id().alias("p")).distinct().groupBy("item_id").count().agg(F.max("count")).first()[0] == 1


@pytest.mark.parametrize(("name", "scans"), [("index_overall", 1), ("index_by_category", 2), ("index_summary", 2), ("index_links", 1)])
def test_rows_are_read_once_and_stay_with_their_item(spark, name, scans):
    text = plan(QUERIES[name](spark, SMALL))
    assert len([x for x in text.split("\n") if "Scan parquet" in x and "l_partkey" in x]) == scans  # one more for the gates of categories


@pytest.mark.parametrize("name", ["category_summary", "comparison", "excluded_moves", "headline_gap", "index_links", "index_overall", "index_by_category", "price_movers_down", "price_movers_up", "item_price_changes", "basket_summary"])
def test_all_exchanges_of_lines_and_items_follow_the_rows(spark, monkeypatch, name):
    """What is dealt by item is dealt in parts whose number follows the rows, on both sides of the join with the items and for whatever comes after it."""
    monkeypatch.setattr(adapters, "ROWS_A_TASK", 100)
    found = re.findall(r"Exchange hashpartitioning\((?:\w+#\d+L?, )*(?:l_partkey|item_id)#\d+L?(?:, \w+#\d+L?)*, (\d+)\)", plan(QUERIES[name](spark, SMALL)))
    assert len(found) >= 2 and set(found) == {str(adapters.item_parts(spark, SMALL))} and int(found[0]) > 40


@pytest.mark.parametrize("name", ["comparison", "excluded_moves", "headline_gap", "index_links", "index_overall", "price_movers_down", "price_movers_up"])
def test_items_are_hashed_a_part_at_a_time(spark, name):
    """Lines meet their items part by part: no broadcast of all items (whose size the files understate), no sort of lines, on small tables as on large ones."""
    joins = re.findall(r"(\w+Join) \[(?:l_partkey|item_id)#\d+L?\], \[(?:p_partkey|item_id)#\d+L?\]", plan(QUERIES[name](spark, SMALL)))
    assert joins and set(joins) == {"ShuffledHashJoin"}


def test_parts_follow_the_items_too(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(adapters, "ROWS_A_TASK", 100)
    spark.range(10).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(5000).write.parquet(f"{tmp_path}/part.parquet")
    assert adapters.item_parts(spark, str(tmp_path)) == 50


def test_enough_outlets_and_items_of_a_category(spark):
    """An item of several outlets is one item; rows without an outlet or an item count as none."""
    rows = [("a", "1", 1), ("a", "2", 1), ("a", "2", 2), ("a", "2", 3)] + [("b", "1", 1), ("b", "2", 1), ("b", "3", 2), ("b", "3", None), ("b", "3", None)]
    rows += [("c", "1", n) for n in range(5)] + [("c", None, n) for n in range(5)] + [("d", None, 1), ("d", "1", 2), ("d", "2", 3), (None, "1", 9)]
    found = basket._enough(spark.createDataFrame(rows * 2, "category string, outlet_id string, item_id long"), DEFAULTS)
    assert sorted(x[0] for x in found.collect()) == ["a", "d"]


def test_all_slices_are_the_union_of_slices(spark):
    rows = adapters.priced(spark, SMALL).unionByName(adapters.priced(spark, SMALL).limit(3).withColumn("category", F.lit(None).cast("string")))
    one, two = basket.all_slices(rows), basket.overall_slice(rows).unionByName(basket.category_slices(rows))
    count = lambda df: sorted(map(tuple, df.groupBy("slice", "item_id", "period").agg(F.count("*"), F.sum("price")).collect()))
    assert count(one) == count(two)


def test_movers_keep_the_parts(spark, monkeypatch):
    monkeypatch.setattr(adapters, "ROWS_A_TASK", 100)
    assert QUERIES["item_price_changes"](spark, SMALL).rdd.getNumPartitions() == adapters.item_parts(spark, SMALL) > 40


def test_a_basket_is_counted_where_its_items_are(spark):
    text = plan(QUERIES["basket_summary"](spark, SMALL))
    assert "REPARTITION_BY_NUM" in text and not re.search(r"Exchange hashpartitioning\(item_id#\d+L?, period", text)


def test_redone_links_need_no_join_of_prices_with_prices(spark):
    prices = spark.createDataFrame(
        [(1, "2026-01", 10.0, "1", "a"), (1, "2026-02", 11.0, "1", "a"), (1, "2026-03", None, "1", "a"), (2, "2026-01", 5.0, "2", None), (2, "2026-03", 6.0, "2", None)],
        maintained.PRICES,
    )
    pairs = spark.createDataFrame([(s, b, p) for s in ("overall", "a") for b, p in (("2026-01", "2026-02"), ("2026-02", "2026-03"))], "slice string, before string, period string")
    judged = maintained._redone(prices, pairs, None, DEFAULTS)
    assert sorted(map(tuple, judged.select("slice", "before", "period", "item_id", "price", "previous").collect())) == [(s, "2026-01", "2026-02", 1, 11.0, 10.0) for s in ("a", "overall")]
    assert len(re.findall(r"^.*Join .*$", plan(judged), re.M)) == 1


def test_first_months_are_found_without_a_sort(spark):
    first = adapters.first_months(spark, SMALL)
    assert "SortAggregate" not in plan(first)
    rows = adapters.observations(spark, SMALL).select("item_id", "period")
    assert sorted(first.collect()) == sorted(rows.groupBy("item_id").agg(F.min("period").alias("period")).collect())
    assert sorted(adapters.item_months(spark, SMALL).collect()) == sorted(rows.distinct().collect())


def test_linked_rows_are_dealt_in_parts_that_follow_them(spark, monkeypatch):
    monkeypatch.setattr(linking, "ROWS_A_TASK", 500)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        linked = QUERIES["link_history"](spark, SMALL)
        text = plan(linked)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(re.findall(r"Exchange hashpartitioning\(hash#\d+L?, name#\d+, (\d+)\), REPARTITION_BY_NUM", text)) == {str(-(-linked.count() // 500))}
    own = text[text.index("Window [row_number()") :]  # the rows that are not renamed: dealt once
    assert own[: own.index("FileScan")].count("Exchange hashpartitioning") == 1


def test_rows_of_one_key_link_alike_whatever_the_parts(spark, monkeypatch):
    rows = [("o", None if n % 2 else 8.0, "oz", m, p, k) for n, k in enumerate(("cheeseburger", "cheeseburgers", "soup", "soup")) for m in ("2026-02", None, "2026-01") for p in (3, None, 3)]
    parsed = spark.createDataFrame(rows, "outlet_id string, size_value double, size_unit string, period string, position int, match_key string")
    known = spark.createDataFrame([("o", None, "oz", "soup", "2025-01")], "outlet_id string, size_value double, size_unit string, match_key string, first_seen string")
    found = []
    for n in (1, 1000):
        monkeypatch.setattr(linking, "ROWS_A_TASK", n)
        found.append(sorted(map(repr, linking.link_items(parsed, known).collect())))
    assert found[0] == found[1] and len(found[0]) == len(rows)
    assert sum("is_new=True" in x for x in found[0]) == 3 and not any("new_key='soup'" in x and "size_value=None" in x and "is_new=True" in x for x in found[0])
