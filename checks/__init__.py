"""Queries over the given tables, their SQL counterparts, and what both share."""
