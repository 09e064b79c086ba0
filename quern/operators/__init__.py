"""Operators over DataFrames: relational rewrites, time series, vector search."""
