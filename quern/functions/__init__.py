"""Operators grouped by theme; every function maps DataFrames to DataFrames."""
