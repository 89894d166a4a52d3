from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blotter.functions import field_at, first_token, strip_whitespace
from blotter.operators import filters

FEW = settings(
    max_examples=15,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
LINE = st.text(st.sampled_from(list(", \t\x0b\x1c\x85\xa0　ab\"")), max_size=12)


def one_by_one(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


@FEW
@given(st.lists(LINE, min_size=1, max_size=30))
def test_strip_is_python_strip(spark, lines):
    assert one_by_one(spark, lines, strip_whitespace) == [t.strip() for t in lines]


@FEW
@given(st.lists(LINE, min_size=1, max_size=30))
def test_field_is_python_split_or_null(spark, lines):
    want = [(t.split(",") + [None] * 6)[2] for t in lines]
    assert one_by_one(spark, lines, lambda c: field_at(c, 2)) == want


def test_field_separator_is_literal(spark):
    assert one_by_one(spark, ["a|b|c", "a.b"], lambda c: field_at(c, 1, "|")) == ["b", None]


@FEW
@given(st.lists(LINE, min_size=1, max_size=30))
def test_first_token_is_python_split(spark, lines):
    assert one_by_one(spark, lines, first_token) == [t.split(" ")[0] for t in lines]


def test_night_and_day_split_the_known_hours(spark):
    hours = spark.createDataFrame(
        [(f"{h:02d}",) for h in range(24)] + [(None,)], "hour string"
    )
    night = {r["hour"] for r in hours.filter(filters.at_night()).collect()}
    day = {r["hour"] for r in hours.filter(filters.by_day()).collect()}
    assert night == {"22", "23", "00", "01", "02", "03", "04", "05", "06"}
    assert not night & day and len(night | day) == 24


def test_box_edges_are_outside(spark):
    points = spark.createDataFrame(
        [(42.0, -87.0), (40.0, -87.0), (45.0, -87.0), (42.0, -90.0), (42.0, -85.0)],
        "Latitude double, Longitude double",
    )
    assert points.filter(filters.in_open_box()).count() == 1


def test_years_keep_later_ones_but_not_the_excluded(spark):
    years = spark.createDataFrame([(y,) for y in (2000, 2001, 2020, 2021, 2022, None)], "Year int")
    kept = [r["Year"] for r in years.filter(filters.year_range()).collect()]
    assert kept == [2001, 2020, 2022]
