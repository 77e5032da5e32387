"""Operators over long panel tables; every one is a function from DataFrames to a DataFrame."""
