"""Operators on poll tables: each takes and returns DataFrames."""
