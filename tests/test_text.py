import pytest
from pyspark.sql import functions as F

from pricebasket.functions import text


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(f(F.col("t"))).collect()]


def test_prices(spark):
    cases = {
        "$12.99": 1299, "12.99": 1299, "$8": 800, "  $ 15.50  ": 1550, "$249.99": 24999, "$0.99": 99, "$1,299.00": None, "Market Price": None, "": None, "MP": None, "2026": None, "$0.01": None, "$350.00": None,
        "2 for $5": 200, "$.99": 9900, "12.999": 1299, "0.75": 75, "250": 25000, "250.01": None, "9" * 30: None, None: None,
    }
    assert column(spark, list(cases), text.parse_price) == list(cases.values())


@pytest.mark.parametrize(
    ("name", "rest", "value", "unit"),
    [
        ("Soft Drink (16 oz)", "Soft Drink ()", 16.0, "oz"), ("6-Piece Nuggets", " Nuggets", 6.0, "pc"), ("Cheeseburger", "Cheeseburger", None, None), ("Drink 16 ounces", "Drink ", 16.0, "oz"),
        ("12 oz steak with 8 oz fries", " steak with 8 oz fries", 12.0, "oz"), ("2 liter Cola", "2 liter Cola", None, None), ("2 in 1 combo", " 1 combo", 2.0, "in"), ("Tea 12 oz", "Tea ", 12.0, "oz"),
    ],
)
def test_sizes(spark, name, rest, value, unit):
    t = F.col("t")
    row = spark.createDataFrame([(name,)], "t string").select(text.without_size(t), text.size_value(t), text.size_unit(t)).first()
    assert tuple(row) == (rest, value, unit)


def test_keys(spark):
    cases = {"The Classic Cheeseburger": "cheeseburger", "BBQ Burger!": "bbq burger", "Mac & Cheese": "mac and cheese", "Mac and Cheese": "mac and cheese", "The House Special": "the house special", "jalapeño": "jalape o", "寿司": ""}
    assert column(spark, list(cases), text.match_key) == list(cases.values())


def test_names_months_labels(spark):
    assert column(spark, [" - a  b · ", "x" * 200], text.clean_name) == ["a b", "x" * 120]
    assert column(spark, ["2026-2", "2026-10"], text.period_order) == [2026 * 12 + 2, 2026 * 12 + 10]
    assert column(spark, ["fast_food"], text.category_label) == ["Fast food"]
