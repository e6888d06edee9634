"""Operators on DataFrames and stored tables."""
