"""Outlet configuration and its checks (S3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("fast_food", "casual", "mid_range")
RENDERERS = ("static", "browser")


def violations(config: DataFrame, categories: tuple[str, ...] | None = CATEGORIES, renderers: tuple[str, ...] = RENDERERS) -> DataFrame:
    """id and problem of each fault: an unknown category or renderer (null: static), an empty selector, a repeated id, no outlets at all."""
    category = F.lit(False) if categories is None else ~F.coalesce(F.col("category").isin(*categories), F.lit(False))
    renderer = ~F.coalesce("renderer", F.lit("static")).isin(*renderers)
    rules = [(category, F.concat(F.lit("unknown category "), F.coalesce("category", F.lit("null")))), (renderer, F.concat(F.lit("unknown renderer "), F.col("renderer")))]
    rules += [(F.coalesce(F.trim(f"selectors.{s}"), F.lit("")) == "", F.lit(f"no selector for {s}")) for s in ("item", "name", "price")]
    found = config.select("id", F.explode(F.filter(F.array(*(F.when(bad, what) for bad, what in rules)), lambda x: x.isNotNull())).alias("problem"))
    repeated = config.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("repeated id").alias("problem"))
    none = config.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(None).cast("string").alias("id"), F.lit("no outlets").alias("problem"))
    return reduce(DataFrame.unionByName, (found, repeated, none))


def validated(config: DataFrame, **rules: tuple[str, ...]) -> DataFrame:
    """config with renderers filled in; ValueError that names the faults, ids in order."""
    bad = violations(config, **rules).orderBy("problem", "id").limit(50).collect()
    if bad:
        raise ValueError("; ".join(f"{r['id']}: {r['problem']}" for r in bad))
    return config.withColumn("renderer", F.coalesce("renderer", F.lit("static")))


def only(outlets: DataFrame, ids: list[str] | None) -> DataFrame:
    """The outlets with these ids, all if none are given; ValueError if none match."""
    if not ids:
        return outlets
    kept = outlets.filter(F.col("id").isin(*ids))
    if kept.isEmpty():
        raise ValueError(f"no outlet matches {sorted(ids)}")
    return kept
