"""Items from pages, as a distributed job.

A helper reads each page once and gives name and price texts; prices, names, sizes and the gates are Column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricebasket.functions import html
from pricebasket.functions.text import PRICE_NUMBER, clean_name, parse_price, size_unit, size_value
from pricebasket.session import ship_package
from pricebasket.settings import DEFAULTS, Settings

TEXTS = "outlet_id string, period string, position int, name_text string, price_text string, used_fallback boolean, blocks int, selector string"


def page_texts(pages: DataFrame, outlets: DataFrame, settings: Settings = DEFAULTS, parse: Callable[[str], html.Page] = html.parse) -> DataFrame:
    """Name and price texts of every page, in page order; a page without any gives one row of nulls with its blocks."""
    ship_package(pages.sparkSession)
    least, most = settings.min_dollars, settings.max_dollars
    joined = pages.select("outlet_id", "period", "html").join(outlets.select(F.col("id").alias("outlet_id"), "selectors"), "outlet_id", "left")
    flat = joined.select("outlet_id", "period", F.coalesce("html", F.lit("")).alias("html"), *(F.coalesce(f"selectors.{s}", F.lit("")).alias(s) for s in ("item", "name", "price")))

    number_in = re.compile(PRICE_NUMBER)

    def usable(name: str, price: str) -> bool:
        number = number_in.search(price.replace(",", ""))
        return bool(number) and least <= float(number[1]) <= most and len(" ".join(name.split()).strip(" -–—·|")) >= 3

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page in frame.itertuples(index=False):
                found = parse(page.html)
                blocks, pairs = html.by_selectors(found, page.item, page.name, page.price)
                swept = not any(usable(*p) for p in pairs)
                if swept:
                    pairs = html.by_sweep(found)
                out += [
                    (page.outlet_id, page.period, k, n, p, swept, blocks, page.item) for k, (n, p) in enumerate(pairs)
                ] or [(page.outlet_id, page.period, None, None, None, swept, blocks, page.item)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TEXTS.split(", ")]).astype({"position": "Int32", "blocks": "int32"})

    return flat.mapInPandas(run, TEXTS)


def page_items(texts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Usable items of each page, each name and price once, the first."""
    named = texts.filter("name_text is not null").select(
        "outlet_id", "period", "position", "used_fallback", clean_name(F.col("name_text")).alias("observed_name"),
        parse_price(F.col("price_text"), settings).alias("price_cents")
    )
    good = named.filter(F.col("price_cents").isNotNull() & (F.length("observed_name") >= 3))
    once = Window.partitionBy("outlet_id", "period", F.lower("observed_name"), "price_cents").orderBy("position")
    first = good.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
    return first.withColumn("size_value", size_value(F.col("observed_name"))).withColumn("size_unit", size_unit(F.col("observed_name")))
