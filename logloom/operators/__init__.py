"""Operators: each takes DataFrames with the entry columns and returns DataFrames."""
