"""Matched-basket price indices on Spark."""
