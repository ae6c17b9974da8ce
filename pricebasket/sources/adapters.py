"""Star-schema test tables as outlets, items, observations, pages and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebasket.functions.text import match_key, period_of

CALM = "p_retailprice * (1 - l_discount) * (1 + l_tax)"
WILD = "l_extendedprice / l_quantity"
# What a task that has an item's rows together takes, so that its memory stays as it is when the tables grow.
ROWS_A_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.col("r_name").alias("category"),
        F.concat(F.lit("https://outlet"), "s_suppkey", F.lit(".example.com/menu")).alias("url")
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").count()
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("bigint").alias("item_id"), (F.col("p_partkey") % n).cast("string").alias("outlet_id"), F.col("p_name").alias("canonical_name"), match_key(F.col("p_name")).alias("match_key"),
        (F.col("p_size") % 3).cast("double").alias("size_value"), F.lit("oz").alias("size_unit"), F.lit("1995-01").alias("first_seen"), F.lit("1995-01").alias("last_seen"),
    )


def item_parts(spark: SparkSession, sf_dir: str) -> int:
    """How many parts observations and items are dealt into by item: by their number, which the files' footers tell."""
    rows = max(table(spark, sf_dir, name).count() for name in ("lineitem", "part"))
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))


def observations(spark: SparkSession, sf_dir: str, price: str = CALM, parts: int | None = None) -> DataFrame:
    """parts: dealt by item into so many, the items' prices too: a part's are hashed, so that neither a broadcast nor a sort grows with the tables."""
    lines, listed = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    if parts:
        lines, listed = lines.repartition(parts, "l_partkey"), listed.repartition(parts, "p_partkey").hint("shuffle_hash")
    if "p_retailprice" in price:
        lines = lines.join(listed, F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(
        F.col("l_partkey").cast("bigint").alias("item_id"), period_of(F.col("l_shipdate")).alias("period"), F.round(F.expr(f"({price}) * 100")).cast("bigint").alias("price_cents"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("scraped_at"), F.when(F.col("l_linestatus") == "F", "real").otherwise("simulated").alias("dataset"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("observed_name"), F.col("l_orderkey").cast("bigint").alias("order_key"), F.col("l_linenumber").cast("int").alias("position"),
    )


def item_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id and period of observations, once each; dealt by item."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate").repartition(item_parts(spark, sf_dir), "l_partkey")
    return lines.select(F.col("l_partkey").cast("bigint").alias("item_id"), period_of(F.col("l_shipdate")).alias("period")).distinct()


def first_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id and the first period of its observations; dealt by item. The least of moments, which have a fixed width, is kept without a sort."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate").repartition(item_parts(spark, sf_dir), "l_partkey")
    return lines.groupBy(F.col("l_partkey").cast("bigint").alias("item_id")).agg(period_of(F.min("l_shipdate")).alias("period"))


def priced(spark: SparkSession, sf_dir: str, price: str = CALM) -> DataFrame:
    """Observations with outlets and categories, the index's input; dealt by item, in parts whose number grows with the rows."""
    parts = item_parts(spark, sf_dir)
    own = items(spark, sf_dir).select("item_id", F.col("canonical_name").alias("item"), "outlet_id")
    outlet = outlets(spark, sf_dir).select(F.col("id").alias("outlet_id"), F.col("name").alias("outlet"), "category")
    rows = observations(spark, sf_dir, price, parts).select("item_id", "period", F.col("price_cents").alias("price"))
    return rows.join(own.join(outlet, "outlet_id").repartition(parts, "item_id").hint("shuffle_hash"), "item_id")


def collection_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").count()
    status = F.when(F.col("o_orderstatus") == "F", "fetched").when(F.col("o_orderstatus") == "O", "skipped").otherwise("error")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % n).cast("string").alias("outlet_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ran_at"), status.alias("status"),
        F.lit(None).cast("string").alias("reason"), F.lit(0).alias("items_found"), F.col("o_orderkey").cast("bigint").alias("entry")
    )


def monthly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """period, cents and n of each month's orders: the stand-in for an official series. Exact sums, so that no order of adding shows."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return table(spark, sf_dir, "orders").groupBy(period_of(F.col("o_orderdate")).alias("period")).agg(F.sum(cents).alias("cents"), F.count("*").alias("n"))


def official_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_totals(spark, sf_dir).select("period", (F.col("cents") / (F.col("n") * 100.0)).alias("cpi"))


def payload(spark: SparkSession, sf_dir: str, series_id: str = "SERIES") -> DataFrame:
    """The monthly means as the official payload, with an annual mean and a missing value to drop."""
    month = official_series(spark, sf_dir).select(
        F.struct(
            F.substring("period", 1, 4).alias("year"), F.concat(F.lit("M"), F.substring("period", 6, 2)).alias("period"),
            F.col("cpi").cast("string").alias("value")
        ).alias("d")
    )
    extra = F.array(*(F.struct(F.lit(y).alias("year"), F.lit(p).alias("period"), F.lit(v).alias("value")) for y, p, v in (("1999", "M13", "1.0"), ("2024", "M01", "-"))))
    whole = month.agg(F.concat(F.collect_list("d"), extra).alias("data"))  # one entry a month
    return whole.select(F.lit("REQUEST_SUCCEEDED").alias("status"), F.struct(F.array(F.struct(F.lit(series_id).alias("seriesID"), "data")).alias("series")).alias("Results"))


def menu_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages of 50 items each, made from the items, and their outlets' selectors; items stand twice, some lack a price."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", F.format_string("$%.2f", 1 + F.pmod("p_partkey", F.lit(200)).cast("double") / 4).alias("p"))
    block = F.concat(
        F.lit('<div class="menu-item"><h3 class="n"><a>'), "p_name", F.lit(" No "), "k", F.lit("</a></h3>"),
        F.when(F.col("k") % 7 == 0, "").otherwise(F.concat(F.lit('<span class="p">'), "p", F.lit("</span>"))), F.lit("</div>")
    )
    page = rows.withColumn("outlet_id", F.floor(F.col("k") / 50).cast("string")).groupBy("outlet_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", block.alias("b")))), lambda x: F.concat(x.b, x.b)), "\n").alias("html")
    )
    pages = page.select("outlet_id", F.lit("2024-01").alias("period"), F.concat(F.lit("<html><body>"), "html", F.lit("</body></html>")).alias("html"))
    selectors = F.struct(F.lit(".menu-item").alias("item"), F.lit(".n a").alias("name"), F.lit("span.p").alias("price"))
    return pages, pages.select(F.col("outlet_id").alias("id"), selectors.alias("selectors"))


def plain_pages(spark: SparkSession, sf_dir: str, selector: str) -> tuple[DataFrame, DataFrame]:
    """Pages of 50 items, each a paragraph of a bold name and a price after it; the selector picks the paragraphs or not. Items stand twice, some lack a price."""
    k = F.col("p_partkey")
    price = F.when(k % 7 == 0, "").otherwise(F.format_string(" <i>$%.2f</i>", 1 + F.pmod(k, F.lit(200)).cast("double") / 4))
    rows = table(spark, sf_dir, "part").select(
        k.alias("k"), F.floor(k / 50).cast("string").alias("outlet_id"),
        F.concat(F.lit("<p><b>"), "p_name", F.lit(" No. "), k, F.lit("x</b>"), price, F.lit("</p>")).alias("b")
    )
    page = rows.groupBy("outlet_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "b"))), lambda x: F.concat(x.b, x.b)), "\n").alias("html"))
    pages = page.select("outlet_id", F.lit("2024-01").alias("period"), F.concat(F.lit("<html><body>"), "html", F.lit("</body></html>")).alias("html"))
    selectors = F.struct(F.lit(selector).alias("item"), F.lit("b").alias("name"), F.lit("::text_after_name").alias("price"))
    return pages, pages.select(F.col("outlet_id").alias("id"), selectors.alias("selectors"))


def fragments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A page for each item that is a fragment without any element around it: the price is in bare text, or in a bold one beside the name."""
    k, price = F.col("p_partkey"), F.format_string("$%.2f", 1 + F.pmod("p_partkey", F.lit(200)).cast("double") / 4)
    name = F.concat("p_name", F.lit(" No. "), k, F.lit("x"))
    text = F.when(k % 2 == 0, F.concat(name, F.lit(" <b>"), price, F.lit("</b>"))).otherwise(F.concat(price, F.lit(" "), name))
    pages = table(spark, sf_dir, "part").select(k.cast("string").alias("outlet_id"), F.lit("2024-01").alias("period"), text.alias("html"))
    selectors = F.struct(F.lit(".no-such").alias("item"), F.lit("b").alias("name"), F.lit("i").alias("price"))
    return pages, pages.select(F.col("outlet_id").alias("id"), selectors.alias("selectors"))
