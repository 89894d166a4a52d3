"""Calendar columns of an incident, and the projections around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.functions import hour_of_day, parse_day


def with_calendar(df: DataFrame) -> DataFrame:
    """Add Day, Month, WeekDay (1 = Sunday) and hour; overwrite Year from the date."""
    day = F.col("Day")
    return df.withColumn("Day", parse_day(F.col("Date"))).withColumns(
        {
            "Month": F.month(day),
            "WeekDay": F.dayofweek(day),
            "Year": F.year(day),
            "hour": hour_of_day(F.col("Date")),
        }
    )


def without_dates(df: DataFrame) -> DataFrame:
    """Drop the date text and the day once their parts are columns."""
    return df.drop("Date", "Day")


def preview(df: DataFrame, key: str = "ID", rows: int = 20) -> DataFrame:
    """The first rows by key: a bounded top-k per task, no full sort."""
    return df.orderBy(F.col(f"`{key}`")).limit(rows)
