"""Operators on DataFrames: find, aggregate, update."""
