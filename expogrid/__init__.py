"""Weighted-exposure analytics over large unit-level tables, on Spark DataFrames."""
