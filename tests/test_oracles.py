"""Every query with SQL: same rows, same columns, same types as the SQL gives."""

import duckdb
import pytest

import __spark_entry__ as entry
from blotter.operators.columns import with_calendar
from blotter.operators.features import collapse_points
from blotter.plans import domestic_in_homes
from checks.fixture import incident_table, incident_view
from checks.registry import ORACLES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()
TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


def tables_of(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck(sf_dir):
    return tables_of(sf_dir)


@pytest.fixture(scope="module")
def larger_duck(larger_dir):
    return tables_of(larger_dir)


def by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, sf_dir, name):
    same_as_sql(spark, duck, sf_dir, name)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith("planted_")))
def test_same_as_sql_on_more_rows(spark, larger_duck, larger_dir, name):
    """Faults of the fixture meet one another only where there are rows enough."""
    same_as_sql(spark, larger_duck, larger_dir, name)


def same_as_sql(spark, duck, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir)
    result = duck.execute(entry.oracle_sql()[name])
    want_columns = [c[0] for c in result.description]
    want_types = {c[0]: str(c[1]) for c in result.description}
    want = result.fetchall()

    assert want, "an empty answer checks nothing"
    assert {f.name: TYPES[f.dataType.simpleString()] for f in got.schema} == want_types
    assert by_name(got.columns, got.collect()) == by_name(want_columns, want)


def test_the_fixture_can_fail(spark, sf_dir):
    """Places repeat unevenly, years differ from dates, and dates can be bad."""
    incidents = incident_view(spark, sf_dir)
    dated = with_calendar(incidents.withColumnRenamed("Year", "file_year"))
    assert dated.filter("Year <> file_year").count() > 50
    assert dated.filter("Year is null and Date is not null").count() > 10
    late = dated.filter("(Year > 2000 and Year <> 2021) <> (file_year > 2000 and file_year <> 2021)")
    assert late.count() > 0
    points = collapse_points(domestic_in_homes(incident_table(spark, sf_dir)))
    assert points.agg({"weight": "max"}).first()[0] > 10


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_counts_every_event(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and sum(r["cnt"] for r in rows) == 1000


@pytest.mark.parametrize(
    "name, rows",
    [
        ("incidents_domestic", 141),
        ("incidents_street_night", 44),
        ("incidents_street_day", 68),
    ],
)
def test_known_study_sizes(spark, sf_dir, name, rows):
    assert entry.queries()[name](spark, sf_dir).count() == rows
