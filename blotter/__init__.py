"""Incident analytics on PySpark: sources, column functions, operators, plans."""
