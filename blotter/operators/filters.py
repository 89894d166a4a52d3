"""Predicates over incident columns. Each gives one boolean column.

All are plain comparisons on built-in functions, so Catalyst can merge them into
one filter and push what it can into the scan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The study's years, places, hours and map box.
YEAR_AFTER = 2000
YEAR_EXCLUDED = 2021
HOME_PLACES = ("APARTMENT", "RESIDENCE")
STREET_PLACE = "STREET"
NIGHT_FROM_HOUR = 22
NIGHT_TO_HOUR = 6
BOX_LATITUDE = (40, 45)
BOX_LONGITUDE = (-90, -85)


def year_range(after: int = YEAR_AFTER, excluded: int = YEAR_EXCLUDED) -> Column:
    """Every year past ``after`` but one. Applies to the Year the file carries."""
    year = F.col("Year")
    return (year > after) & (year != excluded)


def no_nulls(df: DataFrame, columns: Iterable[str] | None = None) -> Column:
    """True where no column is null, or NaN if floating: the rule of ``na.drop()``.

    Written as separate null tests because those reach the scan, where the
    single counting predicate of ``na.drop()`` cannot. Naming the columns that
    matter keeps the others out of the scan altogether.
    """
    kinds = {field.name: field.dataType for field in df.schema}
    wanted = list(kinds if columns is None else columns)
    tests = [f"`{name}` is not null" for name in wanted]
    tests += [
        f"not isnan(`{name}`)"
        for name in wanted
        if isinstance(kinds[name], (T.DoubleType, T.FloatType))
    ]
    return F.expr(" and ".join(tests))


def drop_any_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return df.filter(no_nulls(df, columns))


def place_in(*places: str) -> Column:
    return F.col("`Location Description`").isin(*places)


def place_is(place: str) -> Column:
    return F.col("`Location Description`") == place


def is_domestic() -> Column:
    return F.col("Domestic")


def in_open_box(latitude=BOX_LATITUDE, longitude=BOX_LONGITUDE) -> Column:
    """Inside the box, its edges excluded."""
    lat, lon = F.col("Latitude"), F.col("Longitude")
    return (
        (lat > latitude[0])
        & (lat < latitude[1])
        & (lon > longitude[0])
        & (lon < longitude[1])
    )


def at_night(start: int = NIGHT_FROM_HOUR, end: int = NIGHT_TO_HOUR) -> Column:
    """From ``start`` past midnight through the whole hour ``end``."""
    hour = F.col("hour").cast("int")
    return (hour >= start) | (hour <= end)


def by_day(start: int = NIGHT_FROM_HOUR, end: int = NIGHT_TO_HOUR) -> Column:
    """The exact complement of the night over known hours."""
    hour = F.col("hour").cast("int")
    return (hour < start) & (hour > end)
