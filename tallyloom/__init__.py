"""Margin tables, grouped rosters, member patterns and keyed draws on Spark DataFrames."""

__version__ = "0.1.0"
