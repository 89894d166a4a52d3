"""The given ``events`` table seen as an incident table, in Spark and in SQL.

Codes stay text in the text view, as in a file; the typed view gives them the
declared type. Both engines build the same rows, so every query can be checked. Dates are
written as text in the session's time zone, which must be UTC; the entry, the benchmark and the tests set it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.schema import CODE_FIELDS, INCIDENT_COLUMNS
from blotter.sources import (
    count_rejects,
    fresh_folder,
    header_line,
    quarantine_incidents,
    read_incidents,
    read_lines,
    read_quarantined,
    read_staged,
    stage_incidents,
)

# Some dates are missing or no dates; the rest is as the stamp says.
_BAD_DATE = "case when event_id % 53 = 0 then 'not a date' when event_id % 59 = 0 then null"

# Some years differ from the date's, two of five incidents are at one place and the others
# at about 1,500, and nulls are in columns of every type.
# Column name -> (expression over events, the expression for the SQL side where
# it differs). ``stamp`` is the event time moved back over some 25 years.
_FIELDS = {
    "ID": ("try_cast(event_id as int)", None),
    "Case Number": ("concat('HX', cast(event_id as string))", None),
    "Date": (
        f"{_BAD_DATE} else date_format(stamp, 'MM/dd/yyyy hh:mm:ss a') end",
        f"{_BAD_DATE} else strftime(stamp, '%m/%d/%Y %I:%M:%S %p') end",
    ),
    "Block": (
        "concat(lpad(cast(event_id % 1000 as string), 3, '0'), 'XX W MAIN ST',"
        " case when event_id % 17 = 0 then ', UNIT 3' else '' end)",
        None,
    ),
    "IUCR": (
        "case when event_id % 7 = 0 then '031A'"
        " else lpad(cast(event_id % 2000 as string), 4, '0') end",
        None,
    ),
    "Primary Type": ("event_type", None),
    "Description": (
        "case when event_id % 61 <> 0 then concat(upper(event_type), ' REPORT') end",
        None,
    ),
    "Location Description": (
        "case event_id % 4 when 0 then 'STREET' when 1 then 'APARTMENT'"
        " when 2 then 'RESIDENCE' else 'BAR, CLUB' end",
        None,
    ),
    "Arrest": ("case when event_id % 67 <> 0 then event_id % 3 = 0 end", None),
    "Domestic": ("user_id % 2 = 0", None),
    "Beat": ("case when event_id % 71 <> 0 then cast(100 + event_id % 2400 as int) end", None),
    "District": ("cast(1 + event_id % 25 as int)", None),
    "Ward": ("cast(1 + event_id % 50 as int)", None),
    "Community Area": ("cast(1 + event_id % 77 as int)", None),
    "FBI Code": (
        "case when event_id % 5 = 0 then '08B'"
        " else lpad(cast(event_id % 27 as string), 2, '0') end",
        None,
    ),
    "X Coordinate": ("cast(1100000 + event_id % 100000 as int)", None),
    "Y Coordinate": ("cast(1800000 + event_id % 150000 as int)", None),
    "Year": (
        "cast(year(stamp) + case when event_id % 19 = 0 then -1 when event_id % 23 = 0 then 1"
        " else 0 end as int)",
        None,
    ),
    "Updated On": (
        "date_format(stamp, 'MM/dd/yyyy hh:mm:ss a')",
        "strftime(stamp, '%m/%d/%Y %I:%M:%S %p')",
    ),
    "Latitude": (
        "round(case when event_id % 11 = 0 then null when event_id % 13 = 0"
        " then cast(36.6 as double) else cast(41.6 as double)"
        " + cast(case when event_id % 5 < 2 then 7 else user_id % 40 end as double)"
        " * cast(0.01 as double) end, 6)",
        None,
    ),
    "Longitude": (
        "round(case when event_id % 11 = 0 then null when event_id % 13 = 0"
        " then cast(-91.7 as double) else cast(-87.9 as double)"
        " + cast(case when event_id % 5 < 2 then 9 else event_id % 37 end as double)"
        " * cast(0.01 as double) end, 6)",
        None,
    ),
    "Location": (
        "concat('(', cast(1100000 + event_id % 100000 as string), ', ',"
        " cast(1800000 + event_id % 150000 as string), ')')",
        None,
    ),
}
assert tuple(_FIELDS) == INCIDENT_COLUMNS

_STAMP = "ts - make_dt_interval(cast((event_id * 37) % 9000 as int))"
_STAMP_SQL = "ts - to_days(cast((event_id * 37) % 9000 as int))"

# A raw line is a file line with faults: padding on some, cut short on others.
_LINE = (
    "case when event_id % 9 = 0 then '  ' else '' end",
    "case when event_id % 101 = 0 then 'cut,short' else line end",
    "case when event_id % 10 = 0 then '\t ' else '' end",
)

# --- Spark side -----------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as incidents with the codes as text."""
    return _view(table(spark, sf_dir, "events"))


def _view(events: DataFrame, typed: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    def expression(name):
        spark_sql, _ = _FIELDS[name]
        return f"try_cast({spark_sql} as int)" if typed and name in CODE_FIELDS else spark_sql

    stamped = events.selectExpr("*", f"{_STAMP} as stamp")
    return stamped.selectExpr(*[f"{expression(name)} as `{name}`" for name in _FIELDS], *extra)


def incident_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as incidents with every column of its declared type."""
    return _view(table(spark, sf_dir, "events"), typed=True)


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points at volume: quantity and price of every line item."""
    return table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")


# Three far-apart groups of very unequal size around given centers, every event in one.
PLANTED = ((41.65, -87.85), (41.95, -87.45), (41.80, -87.60))
_GROUP = "case when event_id % 20 < 13 then 0 when event_id % 20 < 19 then 1 else 2 end"
_PLANTED = [
    "event_id as ID",
    f"{_GROUP} as planted",
    *[
        f"round(case {_GROUP} when 0 then cast({c[0][i]} as double) when 1 then"
        f" cast({c[1][i]} as double) else cast({c[2][i]} as double) end"
        f" + cast({spread} as double) * cast(0.001 as double), 6) as {name}"
        for c, i, spread, name in (
            (PLANTED, 0, "user_id % 7 - 3", "Latitude"),
            (PLANTED, 1, "(event_id % 11) - 5", "Longitude"),
        )
    ],
]
PLANTED_SQL = f"planted_points as (select {', '.join(_PLANTED)} from events)"


def planted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_PLANTED)


def quantity_bucket(k: int):
    """A fixed labelling into k clusters: equal buckets of quantity."""
    return F.expr(f"cast(floor((l_quantity - 1) * {k} / 50) as int)")


_staged: dict[tuple, str] = {}


def _stage_once(spark: SparkSession, sf_dir: str, kind: str, write) -> str:
    """Write a file form of the events once per application, whole, by Spark."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _staged:
        path = fresh_folder(spark, kind)
        write(path)
        _staged[key] = path
    return _staged[key]


def _csv_path(spark: SparkSession, sf_dir: str) -> str:
    return _stage_once(
        spark,
        sf_dir,
        "csv",
        lambda path: text_view(spark, sf_dir).write.option("header", True).csv(path),
    )


def incident_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed events staged as Parquet: what the studies read in practice.

    Filters then meet stored columns, so they reach the scan; on the view they
    would have to compute each column first.
    """
    path = _stage_once(
        spark,
        sf_dir,
        "parquet",
        lambda path: stage_incidents(incident_view(spark, sf_dir), path),
    )
    return read_staged(spark, path)


def incident_table_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a folder for each Year, of which a year filter leaves only some."""
    path = _stage_once(
        spark,
        sf_dir,
        "by-year",
        lambda path: stage_incidents(incident_view(spark, sf_dir), path, by_year=True),
    )
    return read_staged(spark, path)


def incident_table_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by year and, within years, in the order of a curve over the map."""
    path = _stage_once(
        spark,
        sf_dir,
        "by-place",
        lambda path: stage_incidents(
            incident_view(spark, sf_dir), path, by_year=True, by_place=True
        ),
    )
    return read_staged(spark, path)


def csv_quarantined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clean rows and rejected records of the events as incident CSV files."""
    path = _stage_once(
        spark,
        sf_dir,
        "quarantine",
        lambda path: quarantine_incidents(spark, _csv_path(spark, sf_dir), path),
    )
    return read_quarantined(spark, path)


def csv_incidents(spark: SparkSession, sf_dir: str, codes_as_int: bool = True) -> DataFrame:
    """The events as incident CSV files, read back typed."""
    return read_incidents(spark, _csv_path(spark, sf_dir), codes_as_int)


def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rejects(spark, _csv_path(spark, sf_dir))


def raw_lines(spark: SparkSession, sf_dir: str, skip_header: bool = False) -> DataFrame:
    """The events as raw incident lines under one header line, read back as text."""

    def write(path):
        view = _view(table(spark, sf_dir, "events"), extra=("event_id",))
        fields = F.struct(*[F.col(f"`{c}`") for c in INCIDENT_COLUMNS])
        lines = view.select("event_id", F.to_csv(fields).alias("line"))
        header = spark.range(1).select(F.lit(header_line()).alias("value"))
        body = lines.selectExpr(f"concat({', '.join(_LINE)}) as value")
        header.unionAll(body).write.text(path)

    return read_lines(spark, _stage_once(spark, sf_dir, "lines", write), skip_header)


# --- SQL side -------------------------------------------------------------------

_TEXT_COLUMNS = ",\n  ".join(
    f'{(sql or spark_sql).replace(" as string)", " as varchar)")} as "{name}"'
    for name, (spark_sql, sql) in _FIELDS.items()
)

TEXT_SQL = f"""stamped as (select *, {_STAMP_SQL} as stamp from events),
text_view as (select
  {_TEXT_COLUMNS},
  event_id
from stamped)"""

INCIDENT_SQL = f"""{TEXT_SQL},
incidents as (select * exclude (event_id) replace (
  {', '.join(f'try_cast("{c}" as integer) as "{c}"' for c in CODE_FIELDS)})
from text_view)"""


def _csv_field(name: str) -> str:
    text = f'coalesce(cast("{name}" as varchar), \'\')'
    return f"case when contains({text}, ',') then '\"' || {text} || '\"' else {text} end"


LINES_SQL = f"""{TEXT_SQL},
file_lines as (select event_id,
  concat_ws(',', {", ".join(map(_csv_field, INCIDENT_COLUMNS))}) as line
from text_view),
lines as (
  select '{header_line()}' as value
  union all
  select concat({', '.join(_LINE)})
  from file_lines)"""
