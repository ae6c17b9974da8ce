import pytest
from pyspark.sql import functions as F

from pricebasket.operators import basket, movers, series


def index(spark, rows, **columns):
    frame = spark.createDataFrame([(p, i, float(x)) for p, i, x in rows], "period string, item_id long, price double")
    built = basket.build_index(basket.overall_slice(frame))
    return [(r["period"], round(r["value"], 6), r["matched_items"], r["note"]) for r in built.points.orderBy("ord").collect()], built


A, B, C = "2026-01", "2026-02", "2026-03"


def test_flat_and_rise(spark):
    points, _ = index(spark, [(p, i, x) for p in (A, B, C) for i, x in ((1, 10), (2, 20))])
    assert [p[1] for p in points] == [100, 100, 100]
    assert index(spark, [(A, 1, 10), (A, 2, 20), (B, 1, 11), (B, 2, 22)])[0][-1][1] == 110
    assert index(spark, [(A, 1, 10), (B, 1, 11), (C, 1, 12.1)])[0][-1][1] == 121


def test_new_and_vanished_items_are_neutral(spark):
    assert index(spark, [(A, 1, 10), (B, 1, 10), (B, 2, 90), (C, 1, 10), (C, 2, 90)])[0][1][1] == 100
    assert index(spark, [(A, 1, 10), (A, 2, 50), (B, 1, 10), (B, 2, 50), (C, 1, 10)])[0][-1][1] == 100


def test_implausible_moves(spark):
    points, built = index(spark, [(A, 1, 10), (A, 2, 20), (B, 1, 10), (B, 2, 200)])
    assert points[-1][1] == 100
    row = basket.published_excluded(built.excluded).first()
    assert (row["item_id"], row["from"], row["to"], row["change_pct"]) == (2, 20, 200, 900)
    assert index(spark, [(A, 1, 10), (B, 1, 4)])[0][-1][1] == 40  # 60 % is kept
    assert index(spark, [(A, 1, 10), (B, 1, 20)])[0][-1] == (B, 100, 0, basket.ALL_EXCLUDED)


def test_ratio_of_sums_single_and_empty(spark):
    assert 110 < index(spark, [(A, 1, 2), (A, 2, 100), (B, 1, 3), (B, 2, 110)])[0][-1][1] < 111
    assert index(spark, [(A, 1, 10)])[0] == [(A, 100, 0, basket.BASE)]
    assert index(spark, [])[0] == []
    assert index(spark, [(A, 1, 10), (B, 2, 10)])[0] == []


def test_gaps(spark):
    assert index(spark, [(A, 1, 10), (C, 1, 11)])[0][-1][1] == 110
    points, _ = index(spark, [(A, 1, 10), (C, 1, 12), (A, 2, 10), (B, 2, 10), (C, 2, 10)])
    assert points[-1][1] == 100  # item 1 is missing from a month that the slice has
    points, _ = index(spark, [(A, 1, 10), (C, 1, 10), (B, 2, 5), ("2026-04", 2, 5)])
    assert points[1] == (B, 100, 0, basket.NO_PAIRS)


def test_order_of_rows_is_irrelevant(spark):
    rows = [(p, i, 10 + i + k) for k, p in enumerate((A, B, C)) for i in range(20)]
    assert index(spark, rows)[0] == index(spark, rows[::-1])[0]


def test_category_gates(spark):
    rows = [("a", o, i) for o, i in (("1", 1), ("1", 2), ("2", 3))] + [("b", "1", i) for i in range(4)] + [("c", o, i) for o, i in (("1", 7), ("2", 8))] + [(None, "9", 99)]
    frame = spark.createDataFrame([(*r, A, 1.0) for r in rows], "category string, outlet_id string, item_id long, period string, price double")
    assert {r["slice"] for r in basket.category_slices(frame).collect()} == {"a"}


def test_movers(spark):
    frame = spark.createDataFrame([(A, 1, 10.0), (A, 2, 20.0), (B, 1, 12.0), (B, 2, 18.0), (A, 3, 0.0), (B, 3, 5.0), (A, 4, 100.0), (B, 4, 100.04), (A, 5, 1.0)], "period string, item_id long, price double")
    changes = movers.item_price_changes(frame.withColumns({c: F.lit("x") for c in ("item", "outlet", "category")}))
    assert [r["change_pct"] for r in movers.increases(changes).collect()] == [20.0]
    assert [r["change_pct"] for r in movers.decreases(changes).collect()] == [-10.0]


@pytest.mark.parametrize(("period", "last"), [(A, 390 / 380 * 100), ("2030-01", 390.0)])
def test_rebase(spark, period, last):
    frame = spark.createDataFrame([(A, 380.0), (B, 384.0), (C, 390.0)], "period string, value double")
    assert series.rebase(frame, period).orderBy("period").collect()[-1]["value"] == pytest.approx(last)
