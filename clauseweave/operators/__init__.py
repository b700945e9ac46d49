"""Operators on DataFrames, grouped by theme."""
