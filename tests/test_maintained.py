"""The index from stored sums is that of a full build, whatever months were replaced or removed before."""

import random

import pytest

from pricebasket.jobs import maintained
from pricebasket.operators import basket
from pricebasket.settings import Settings
from pricebasket.sources.snapshots import Store

COLUMNS = "item_id long, period string, price double, outlet_id string, category string"
CATEGORY = {"a": "x", "b": "x", "c": "y", "d": None, "e": "z"}


def random_rows(r, months, items=14, share=0.5):
    out = []
    for m in months:
        for i in range(items):
            if r.random() < share:
                o = "abcde"[i % 5]
                out += [(i, m, r.choice([None, 1000.0, 1100.0, 1200.0, 4000.0, 950.0]), o, CATEGORY[o]) for _ in range(r.choice([1, 1, 2]))]
    return out


def shown(index):
    points = {(x["slice"], x["period"], round(x["value"], 6), x["matched_items"], round(x["link"], 9), x["note"]) for x in index.points.collect()}
    return points, {(x["slice"], x["period"], x["item_id"], x["from"], x["to"], round(x["change_pct"], 6)) for x in index.excluded.collect()}


@pytest.mark.parametrize(("seed", "least"), [(1, 2), (3, 3)])
def test_a_history_of_replaced_months(spark, tmp_path, seed, least):
    """Months arrive in any order, are replaced, emptied and brought back; the store holds what a full build over the rows that count gives."""
    r, settings, own = random.Random(seed), Settings(min_periods_per_item=least), Store(spark, str(tmp_path / "store"))
    months, held = [f"2026-{m:02d}" for m in range(1, 8)], {}
    steps = [r.sample(months, 5), r.sample(months, 2), [r.choice(months)]]
    for n, step in enumerate(steps):
        rows = random_rows(r, step, share=r.choice([0.2, 0.5])) if n != 2 else []
        held |= {m: [x for x in rows if x[1] == m] for m in step}
        maintained.replace_months(own, spark.createDataFrame(rows + [(None, step[0], 1.0, "a", "x")], COLUMNS), step, f"s{n}", settings)
        whole = spark.createDataFrame(sum(held.values(), []), COLUMNS)
        full = basket.build_index(basket.overall_slice(whole).unionByName(basket.category_slices(whole, settings)), settings)
        assert shown(maintained.maintained_index(own, settings)) == shown(full)


def test_slices_of_one_month_and_of_none(spark, tmp_path):
    own = Store(spark, str(tmp_path / "store"))
    rows = [(1, "2026-01", 100.0, "a", "x"), (2, "2026-01", 100.0, "b", "x")]
    maintained.replace_months(own, spark.createDataFrame(rows, COLUMNS), ["2026-01"], "b0")
    assert [(x["slice"], x["value"], x["note"]) for x in maintained.maintained_index(own).points.collect()] == [("overall", 100.0, basket.BASE)]
    maintained.replace_months(own, spark.createDataFrame([], COLUMNS), ["2026-01"], "b1")
    assert maintained.maintained_index(own).points.count() == 0 and own.snapshot().parts("prices") == {} == own.snapshot().parts("item_months")


def test_a_month_reads_its_neighbours_only(spark, tmp_path):
    """One month of twelve is replaced: prices are read of it and of the months beside it, and the same month again rewrites no item."""
    own, months = Store(spark, str(tmp_path / "store")), [f"2026-{m:02d}" for m in range(1, 13)]
    rows = [(i, m, 100.0 + i + k, "ab"[i % 2], "x") for i in range(10) for k, m in enumerate(months)]
    maintained.replace_months(own, spark.createDataFrame(rows, COLUMNS), months, "b0")
    read, opened, base = [], own.read, own.snapshot()
    own.read = lambda table, schema, parts=None, at=None: read.append((table, None if parts is None else sorted(parts))) or opened(table, schema, parts, at)
    again = [(i, m, p * 1.1, o, c) for i, m, p, o, c in rows if m == "2026-06"]
    after = maintained.replace_months(own, spark.createDataFrame(again, COLUMNS), ["2026-06"], "b1")
    assert [p for t, p in read if t == "prices"] == [["2026-06"], ["2026-05", "2026-07"]]
    assert [p for t, p in read if t == "item_months"] == [[]]
    assert {p for p, f in after.parts("prices").items() if f != base.parts("prices")[p]} == {"2026-06"} and after.parts("item_months") == base.parts("item_months")
    plan = opened("prices", maintained.PRICES, ["2026-05", "2026-07"], after)
    assert {f.split("part=")[1].split("/")[0] for f in plan.inputFiles()} == {"2026-05", "2026-07"}
    full = basket.build_index(basket.overall_slice(spark.createDataFrame([x for x in rows if x[1] != "2026-06"] + again, COLUMNS)))
    own.read = opened
    assert {x for x in shown(maintained.maintained_index(own))[0] if x[0] == "overall"} == shown(full)[0]
    assert maintained.replace_months(own, spark.createDataFrame([], COLUMNS), months, "b1") == after
