"""Operators: each takes a DataFrame (or columns) and gives a DataFrame (or column)."""
