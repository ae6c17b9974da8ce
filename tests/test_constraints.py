"""Rules of stored tables, and tables joined where they lie."""

import random

import pytest
from pyspark.sql import functions as F

from pricebasket.operators import store
from pricebasket.sources import bucketed, constraints, schemas
from pricebasket.sources.snapshots import Change, Store


def test_every_broken_rule_is_counted_in_the_writing_pass(spark, tmp_path):
    good = [(k, "2026-01", 100, "n", "t", "real") for k in range(20)]
    bad = [(3, "2026-01", 100, "n", "t", "real")] * 2 + [(21, "2026-1", 100, "n", "t", "real"), (22, "2026-01", None, None, "t", "odd"), (None, "2026-01", 1, "n", "t", "real"), (99, "2026-01", 1, "n", "t", "real")]
    items = spark.createDataFrame([(k,) for k in range(23)], "item_id long")
    rules = (*constraints.OBSERVATION_RULES, constraints.referring("known", "item_id", items))
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            passes.add(b.num_rows)
            yield b

    frame = spark.createDataFrame(good + bad, schemas.OBSERVATIONS).mapInArrow(counted, schemas.OBSERVATIONS)
    got = {r["rule"]: r["rows"] for r in constraints.write_checked(frame, str(tmp_path / "o"), rules).collect()}
    names = [r.name for r in rules]
    assert got == {names[0]: 2, names[1]: 2, names[2]: 1, names[3]: 1, names[4]: 1}
    assert passes.value == len(good + bad) == spark.read.parquet(str(tmp_path / "o")).count()
    assert constraints.write_checked(spark.createDataFrame(good, schemas.OBSERVATIONS), str(tmp_path / "p"), rules).count() == 0
    assert constraints.write_checked(spark.createDataFrame([], schemas.OBSERVATIONS), str(tmp_path / "q"), rules).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_against_plain_counts(spark, tmp_path, seed):
    r = random.Random(seed)
    pick = lambda *x: r.choice(x)
    rows = [(pick(None, 1, 2, 3), pick(None, "a", "b"), pick(None, -1, 5)) for _ in range(200)]
    known = [(1, "a"), (2, "b"), (1, "a"), (None, "a")]
    rules = (constraints.Rule("there", present=("i", "s")), constraints.Rule("once", key=("i", "s")), constraints.Rule("positive", holds="n > 0"), constraints.referring("known", ("i", "s"), spark.createDataFrame(known, "x long, y string")))
    got = {x["rule"]: x["rows"] for x in constraints.write_checked(spark.createDataFrame(rows, "i long, s string, n long").repartition(3), str(tmp_path / "t"), rules).collect()}
    want = {
        "there": sum(i is None or s is None for i, s, _ in rows), "once": len(rows) - len({x[:2] for x in rows}), "positive": sum(n is None or n <= 0 for *_, n in rows),
        "known": sum(i is not None and s is not None and (i, s) not in known for i, s, _ in rows),
    }
    assert got == {k: v for k, v in want.items() if v}


def test_a_commit_against_a_rule_changes_nothing(spark, tmp_path):
    own, rule = Store(spark, str(tmp_path / "store")), (constraints.Rule("small", holds="id < 5"),)
    own.commit(own.snapshot(), "a", [Change("t", spark.range(3), F.lit("x"), rules=rule)])
    with pytest.raises(ValueError, match="t: not so in 2 rows: small"):
        own.commit(own.snapshot(), "b", [Change("t", spark.range(7), F.lit("x"), rules=rule)])
    assert own.read("t", "id long").count() == 3 and own.snapshot().version == 1


def test_bucketed_tables_meet_without_an_exchange(spark, tmp_path):
    r = random.Random(3)
    observed = spark.createDataFrame([(r.randrange(40), f"2026-0{r.randint(1, 3)}", r.randint(100, 900), "n", "t", r.choice(["real", "simulated"])) for _ in range(300)], schemas.OBSERVATIONS)
    items = spark.createDataFrame([(k, "ab"[k % 2], f"i{k}", f"k{k}", None, None, "x", "x") for k in range(40)], schemas.ITEMS)
    outlets = spark.createDataFrame([("a", "A", "c", "u"), ("b", "B", "c", "u")], schemas.OUTLETS)
    bucketed.write_bucketed(observed, "own_observations", str(tmp_path / "o"), datasets=True, buckets=4)
    bucketed.write_bucketed(items, "own_items", str(tmp_path / "i"), buckets=4)
    got = bucketed.joined_bucketed(spark, "own_observations", "own_items", outlets, "real")
    want = store.joined_observations(observed, items, outlets, "real").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.rindex("SortMergeJoin") : plan.rindex("FileScan parquet")]  # the join of the two tables, down to the second of them
    assert join.count("FileScan parquet") == 1 and "Exchange" not in join and "Bucketed: true" in plan and "PartitionFilters: [isnotnull(dataset" in plan
    with pytest.raises(ValueError):
        bucketed.joined_bucketed(spark, "own_observations", "own_items", outlets, "")
