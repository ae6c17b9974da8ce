"""Names, prices, sizes and months as Column expressions; no Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricebasket.settings import DEFAULTS, Settings

# Words that say nothing of an item's identity, spellings of units, patterns of prices and sizes.
FILLER_WORDS = ["the", "a", "an", "our", "house", "classic", "signature", "famous", "original", "fresh", "new", "special", "style", "served", "with"]
UNITS = {
    "oz": "oz", "ounce": "oz", "ounces": "oz", "lb": "lb", "lbs": "lb", "pound": "lb", "pounds": "lb",
    "pc": "pc", "pcs": "pc", "piece": "pc", "pieces": "pc", "ct": "pc", "count": "pc",
    "inch": "in", "in": "in", "g": "g", "gram": "g", "grams": "g", "ml": "ml", "l": "l",
}
PRICE_NUMBER = r"\$?\s*(\d+(?:\.\d{1,2})?)"
PRICE = f"(?U){PRICE_NUMBER}"
SIZE = r"(?iU)(?<![\d.])(\d+(?:\.\d+)?)\s*[-\s]?\s*(oz|ounces?|lbs?|pounds?|pcs?|pieces?|ct|count|inch|in|g|grams?|ml|l)\b"
EDGES = " -–—·|\t\n"
LONGEST_NAME = 120


def parse_price(text: Column, settings: Settings = DEFAULTS) -> Column:
    """Cents of the first number in a text; null without one or outside the accepted range (F1)."""
    digits = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), PRICE, 1)
    dollars = F.nullif(digits, F.lit("")).try_cast("decimal(20,2)")
    return F.when(dollars.between(settings.min_dollars, settings.max_dollars), (dollars * 100).cast("bigint"))


def size_value(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, SIZE, 1), F.lit("")).try_cast("double")


def size_unit(name: Column) -> Column:
    spellings = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    return F.try_element_at(spellings, F.lower(F.regexp_extract(name, SIZE, 2)))


def without_size(name: Column) -> Column:
    """The name without its first size, what stands around it untouched (F2)."""
    found = F.regexp_extract(name, SIZE, 0)
    at = F.regexp_instr(name, F.lit(SIZE))
    return F.when(at > 0, F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + F.length(found), F.length(name)))).otherwise(name)


def match_key(name: Column) -> Column:
    """The form of a name that is compared."""
    plain = F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), r"[^a-z0-9\s]", " ")
    words = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
    telling = F.filter(words, lambda w: ~w.isin(FILLER_WORDS))
    return F.array_join(F.when(F.size(telling) > 0, telling).otherwise(words), " ")


def clean_name(name: Column) -> Column:
    """White space collapsed, edges stripped, cut to what is shown."""
    return F.substring(F.btrim(F.regexp_replace(name, r"(?U)\s+", " "), F.lit(EDGES)), 1, LONGEST_NAME)


def period_of(moment: Column) -> Column:
    """The calendar month, 'YYYY-MM' (F6)."""
    return F.date_format(moment, "yyyy-MM")


def period_order(period: Column) -> Column:
    """Months in order of time, whatever their padding."""
    parts = F.split(period, "-")
    return F.get(parts, F.lit(0)).try_cast("int") * 12 + F.get(parts, F.lit(1)).try_cast("int")


def dollars(cents: Column) -> Column:
    return cents / F.lit(100.0)


def category_label(category: Column) -> Column:
    """'fast_food' as 'Fast food' (F9)."""
    spaced = F.replace(category, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(F.substring(spaced, F.lit(2), F.length(spaced))))


def cpi_period(year: Column, code: Column) -> Column:
    """'2024' and 'M03' as '2024-03'; null for anything but a month."""
    return F.when(code.rlike("^M(0[1-9]|1[0-2])$"), F.concat_ws("-", F.lpad(year, 4, "0"), F.substring(code, 2, 2)))
