"""Similarity of match keys."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pricebasket.session import ship_package


def ratio(left: str, right: str) -> float:
    """The share of characters that two keys have in common in order; the order of the arguments matters."""
    return SequenceMatcher(None, left, right).ratio() if left and right else 0.0


def ratio_from(left: str, right: str, threshold: float) -> float | None:
    """The ratio, or None where it is below the threshold; upper bounds spare most full comparisons."""
    matcher = SequenceMatcher(None, left, right)
    if matcher.real_quick_ratio() < threshold or matcher.quick_ratio() < threshold:
        return None
    return got if (got := matcher.ratio()) >= threshold else None


def similarity(left: Column, right: Column) -> Column:
    """F5 over two columns, in Arrow batches."""
    from pyspark.sql import SparkSession

    ship_package(SparkSession.active())

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run(left, right)


def best_match(key: str, known: list[str], threshold: float) -> tuple[str | None, float]:
    """The known key that is most like the given one: itself if it is known, else the best ratio, the earliest on ties, from the threshold on.

    Upper bounds of the ratio (by lengths, then by letters) spare most full comparisons; they never reject a match.
    """
    if not key:
        return None, 0.0
    best, score = None, 0.0
    matcher = SequenceMatcher(None)
    for other in known:
        if other == key:
            return other, 1.0
    for other in known:
        # the second sequence is the one that the matcher indexes
        matcher.set_seqs(key, other)
        least = max(score, threshold)
        if matcher.real_quick_ratio() < least or matcher.quick_ratio() < least:
            continue
        if (got := matcher.ratio()) > score:
            best, score = other, got
    return (best, score) if score >= threshold else (None, score)
