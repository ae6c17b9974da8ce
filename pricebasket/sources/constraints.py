"""Rules that stored tables keep (S1): keys, references, values that are there or within bounds.

They are checked in the pass that writes the rows: each rule is a flag on a row, counted by an observation of the very job that
writes, so nothing is scanned twice. A key's repeats are numbered within the key, which costs no exchange where rows are dealt out by
it already; a reference is a left join with the distinct keys it may name.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """name says what must hold. One of: columns that aren't null; a key that is unique (nulls are alike); a condition that isn't false or null; columns
    that, unless one is null, stand in `among` (a frame of such columns)."""

    name: str
    present: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    holds: str | None = None
    refers: tuple[str, ...] = ()
    among: DataFrame | None = None


# The rules of the library's tables.
OUTLET_RULES = (Rule("id, name, category and url are there", present=("id", "name", "category", "url")), Rule("an id stands once", key=("id",)))
ITEM_RULES = (
    Rule("ids, names, keys and months are there", present=("item_id", "outlet_id", "canonical_name", "match_key", "first_seen", "last_seen")),
    Rule("an outlet's key and size stand once", key=("outlet_id", "match_key", "size_value", "size_unit")),
)
OBSERVATION_RULES = (
    Rule("item, month, price, name, time and dataset are there", present=("item_id", "period", "price_cents", "observed_name", "scraped_at", "dataset")),
    Rule("an item has one price a month and dataset", key=("item_id", "period", "dataset")),
    Rule("a dataset is real or simulated", holds="dataset in ('real', 'simulated')"),
    Rule("a month is written as year and month", holds="period rlike '^[0-9]{4}-[0-9]{2}$'"),
)
LOG_RULES = (
    Rule("outlet, time and status are there", present=("outlet_id", "ran_at", "status")),
    Rule("a status is fetched, skipped or error", holds="status in ('fetched', 'skipped', 'error')")
)


def referring(name: str, columns: str | tuple[str, ...], among: DataFrame) -> Rule:
    return Rule(name, refers=(columns,) if isinstance(columns, str) else columns, among=among)


def checked(rows: DataFrame, rules: Iterable[Rule]) -> tuple[DataFrame, Observation]:
    """rows as they are, and what counts the rows against each rule (and all of them) once rows have been written."""
    columns, counts, flags = rows.columns, [F.count(F.lit(1)).alias("rows")], {}
    for n, rule in enumerate(rules):
        flag = f"_rule_{n}"
        if rule.present:
            broken: Column = F.lit(False)
            for c in rule.present:
                broken = broken | F.col(c).isNull()
        elif rule.key:
            broken = F.row_number().over(Window.partitionBy(*rule.key).orderBy(F.lit(1))) > 1
        elif rule.holds is not None:
            broken = ~F.coalesce(F.expr(rule.holds).cast("boolean"), F.lit(False))
        else:
            known = rule.among.select(*(F.col(c).alias(f"{flag}_{k}") for k, c in enumerate(rule.among.columns))).distinct().withColumn(f"{flag}_known", F.lit(True))
            same, there = F.lit(True), F.lit(True)
            for k, c in enumerate(rule.refers):
                same, there = same & (F.col(c) == F.col(f"{flag}_{k}")), there & F.col(c).isNotNull()
            rows = rows.join(known, same, "left")
            broken = there & F.col(f"{flag}_known").isNull()
        rows = rows.withColumn(flag, broken)
        flags[flag] = rule.name
        counts.append(F.count_if(flag).alias(flag))
    seen = Observation()
    return rows.observe(seen, *counts).select(*columns), seen


def broken_rules(spark: SparkSession, rules: Iterable[Rule], seen: Observation) -> DataFrame:
    """rule and rows of each rule that rows were against, once they have been written."""
    found = seen.get
    broken = [(r.name, found[f"_rule_{n}"]) for n, r in enumerate(rules) if found.get(f"_rule_{n}")]
    return spark.createDataFrame(broken, "rule string, rows long")


def write_checked(rows: DataFrame, path: str, rules: Iterable[Rule]) -> DataFrame:
    """Writes rows, and gives the rules that they are against with their counts."""
    rules = tuple(rules)
    kept, seen = checked(rows, rules)
    kept.write.mode("overwrite").parquet(path)
    return broken_rules(rows.sparkSession, rules, seen)
