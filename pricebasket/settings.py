"""Tunables of the jobs, all overridable."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    min_dollars: float = 0.75
    max_dollars: float = 250.0
    match_threshold: float = 0.88
    base_value: float = 100.0
    min_periods_per_item: int = 2
    min_items_per_category: int = 3
    min_outlets_per_category: int = 2
    max_monthly_change_pct: float = 60.0
    series_id: str = "CUUR0000SEFV"
    crawl_delay: float = 3.0
    user_agent: str = "pricebasket"


DEFAULTS = Settings()
