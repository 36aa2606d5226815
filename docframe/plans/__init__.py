"""Queries: their trees, text, parameters, and translation to Spark columns."""
