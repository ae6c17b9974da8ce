"""Sharding by proportional stratified interleaving, in DataFrame functions alone.

Rows are shuffled by a seeded hash and ranked within their source; row r of a source's n rows gets the fractional rank
(2r - 1) / 2n. Sorted by it, every stretch of rows holds the sources in their overall proportions, so cutting the order
into equal stretches gives shards that each match the mixture. Law: `rows` (counts differ by one at most).

No row number over everything is taken in one task: ranks come from counts of (source, hash range) cells and from row
numbers within a cell, places from counts of fractional-rank ranges and row numbers within a range. Both kinds of cells
hold about CELL rows whatever a source's share, so a source with a third of all rows is spread over many tasks.

Null texts have 0 bytes and so size 1; null sources are one source of their own, ordered first; null ids are rows like
others. Rows of one id are told apart by their texts; rows equal in both
are interchangeable, each gets a slot of its own. Empty tables give empty
results. Columns of other names play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricebasket.llm.common import documents, whole_text

SHARDS, SEED = 8, "interleave-1"
#: Rows of a cell, about.
CELL = 1000
#: Cells whose counts are summed up in one task.
SPAN = 4096


def offsets(counts: DataFrame, keys: list[str], cell: str, n: str, name: str) -> DataFrame:
    """counts with the sum of n over earlier cells of the same keys, summed up span by span: no task gets more than SPAN cells, or one row for each span."""
    spans = counts.withColumn("_span", F.floor(F.col(cell) / SPAN))
    within = Window.partitionBy(*keys, "_span").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    totals = spans.groupBy(*keys, "_span").agg(F.sum(n).alias("_total"))
    over = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.withColumn("_earlier", F.coalesce(F.sum("_total").over(over), F.lit(0))).drop("_total")
    joined = spans.withColumn("_own", F.coalesce(F.sum(n).over(within), F.lit(0)))
    return joined.join(earlier, [*keys, "_span"]).select(*keys, cell, (F.col("_own") + F.col("_earlier")).alias(name))


def _cell(hash_column: Column, cells: int) -> Column:
    """The hash's range: its first 32 bits, in as many equal parts."""
    return F.floor(F.conv(F.substring(hash_column, 1, 8), 16, 10).cast("long") * cells / F.lit(1 << 32)).cast("long")


def interleave(df: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of each row of (doc_id, text, source)."""
    total = df.count()
    cells = max(1, -(-total // CELL))
    text = whole_text()
    rows = df.select(
        "doc_id", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("_source"), "source",
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(text))).alias("_hash"),
    ).withColumn("_cell", _cell(F.col("_hash"), cells))
    counts = rows.groupBy("_source", "_cell").agg(F.count("*").alias("_n"))
    first = offsets(counts, ["_source"], "_cell", "_n", "_before")
    of_source = counts.groupBy("_source").agg(F.sum("_n").alias("_all"))
    known = first.join(of_source, "_source")
    in_cell = Window.partitionBy("_source", "_cell").orderBy("_hash", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("_row", F.row_number().over(in_cell)).join(known, ["_source", "_cell"])
    share = ranked.withColumn("_share", (2 * (F.col("_before") + F.col("_row")) - 1) / (2 * F.col("_all")))
    share = share.withColumn("_range", F.floor(F.col("_share") * cells).cast("long")).select("doc_id", "source", "_source", "size", "text_crc32", "_share", "_range")
    ranges = share.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = offsets(ranges.withColumn("_one", F.lit(0)), ["_one"], "_range", "_n", "_start").drop("_one")
    in_range = Window.partitionBy("_range").orderBy("_share", "_source")
    placed = share.withColumn("_place", F.row_number().over(in_range) - 1).join(starts, "_range").withColumn("_place", F.col("_place") + F.col("_start"))
    shard = F.expr(f"cast(_place * {shards}L div {max(1, total)}L as int)")
    return placed.withColumn("shard", shard).select("doc_id", "source", "size", "text_crc32", "shard", F.expr(f"_place - (shard * {total}L + {shards - 1}L) div {shards}L").alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select(F.col("doc_id").cast("long"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP5_SQL = rf"""
with bits as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, cast(i as bigint))) as t),
rows as (
  select doc_id, case when source is null then '' else 's' || source end as src, strlen(coalesce(text, '')) + 1 as size,
         md5('{SEED}|' || coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, ''))) as h,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: cast('0x' || x as bigint)) as b from documents),
summed as (
  select r.* exclude (b), xor(4294967295, list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), cast(4294967295 as bigint))) as crc from rows r, bits),
ranked as (
  select *, row_number() over (partition by src order by h, doc_id, crc, size) as r, count(*) over (partition by src) as n, count(*) over () as total from summed),
placed as (
  select *, row_number() over (order by cast(2 * r - 1 as double) / cast(2 * n as double), src) - 1 as place from ranked),
cut as (select *, place * {SHARDS} // total as shard from placed)
select doc_id, cast(size as bigint) as size, cast(crc as bigint) as text_crc32, 'rows' as law, cast(shard as int) as shard,
       cast(place - (shard * total + {SHARDS - 1}) // {SHARDS} as bigint) as slot, cast(null as int) as grown_shard
from cut
"""
