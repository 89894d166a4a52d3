"""Counts per key and column spreads."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.functions import field_at, strip_whitespace

# Fixed value: where the incident type stands in a raw line.
TYPE_POSITION = 5


def count_by(df: DataFrame, key: Column | str, name: str) -> DataFrame:
    """Rows per key as ``(name, cnt)``.

    Tasks count locally first, so the one shuffle carries at most one row per
    key and task, however large a key is.
    """
    key = F.col(f"`{key}`") if isinstance(key, str) else key
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("cnt"))


def count_by_primary_type(incidents: DataFrame) -> DataFrame:
    return count_by(incidents, "Primary Type", "primary_type")


def count_by_line_field(
    lines: DataFrame, index: int = TYPE_POSITION, name: str = "primary_type"
) -> DataFrame:
    """The same count on raw lines by field position; short lines count under null."""
    return count_by(lines, field_at(strip_whitespace(F.col("value")), index), name)


def column_stddev(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Sample standard deviation of each column, in one pass."""
    return df.agg(*[F.stddev_samp(F.col(f"`{c}`")).alias(c) for c in columns])
