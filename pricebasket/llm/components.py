"""Connected components of a graph given as a table of edges, by joins alone: the library's own."""

from __future__ import annotations

from pricebasket.operators.graphs import components

__all__ = ["components"]
