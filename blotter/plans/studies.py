"""The incident selections, and each study as a set of parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.operators import filters as f
from blotter.operators.columns import with_calendar, without_dates


def select_incidents(
    incidents: DataFrame,
    where: Column,
    hours: Column | None = None,
    required: Iterable[str] | None = None,
) -> DataFrame:
    """Dated, complete incidents that satisfy a predicate.

    Years are tested on the file's own Year, before it is overwritten. Tests on
    file columns come first, so only the rows that pass have their date parsed.
    A known hour implies a parsed day: the hour's pattern starts with the day's,
    so testing the hour alone drops every row with an underived column.

    ``required`` names the file columns that must not be null; all by default.
    Fewer of them let a columnar scan skip the rest.
    """
    complete = incidents.filter(f.year_range()).filter(f.no_nulls(incidents, required))
    dated = with_calendar(complete.filter(where)).filter(F.col("hour").isNotNull())
    return without_dates(dated if hours is None else dated.filter(hours))


def domestic_in_homes(incidents: DataFrame, required=None) -> DataFrame:
    where = f.place_in(*f.HOME_PLACES) & f.is_domestic() & f.in_open_box()
    return select_incidents(incidents, where, required=required)


def street_at_night(incidents: DataFrame, required=None) -> DataFrame:
    where = f.place_is(f.STREET_PLACE) & f.in_open_box()
    return select_incidents(incidents, where, f.at_night(), required)


def street_by_day(incidents: DataFrame, required=None) -> DataFrame:
    where = f.place_is(f.STREET_PLACE) & f.in_open_box()
    return select_incidents(incidents, where, f.by_day(), required)


@dataclass(frozen=True)
class Study:
    select: Callable[..., DataFrame]
    algorithm: str
    ks: tuple[int, ...]


# Selection, model and cluster counts of each study.
STUDIES = {
    "domestic_kmeans_30": Study(domestic_in_homes, "kmeans", (30,)),
    "domestic_kmeans_3_to_9": Study(domestic_in_homes, "kmeans", tuple(range(3, 10))),
    "domestic_gmm_3_to_9": Study(domestic_in_homes, "gmm", tuple(range(3, 10))),
    "domestic_kmeans_3": Study(domestic_in_homes, "kmeans", (3,)),
    "street_night_kmeans_3_to_9": Study(street_at_night, "kmeans", tuple(range(3, 10))),
    "street_day_kmeans_30": Study(street_by_day, "kmeans", (30,)),
}
