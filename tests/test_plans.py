"""What the plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from blotter.operators import filters
from blotter.operators.clustering import assign_nearest_center
from blotter.plans import domestic_in_homes, street_by_day
from blotter.operators.scoring import silhouette_scores
from checks.fixture import csv_incidents, incident_table, lineitem_points
from checks.registry import ORACLES, QUERIES


def test_year_filter_reaches_the_csv_scan(spark, sf_dir, plan):
    text = plan(csv_incidents(spark, sf_dir).filter(filters.year_range()))
    pushed = "[IsNotNull(Year), GreaterThan(Year,2000), Not(EqualTo(Year,2021))]"
    assert f"PushedFilters: {pushed}" in text


def test_count_shuffles_once_and_reads_one_column(spark, sf_dir, plan):
    text = plan(entry.queries()["count_by_primary_type"](spark, sf_dir))
    assert len(re.findall(r"^\(\d+\) Exchange$", text, re.M)) == 1
    assert "partial_count(1)" in text
    assert "ReadSchema: struct<event_type:string>" in text


def test_study_is_one_filter_with_every_test_in_the_scan(spark, sf_dir, plan):
    text = plan(domestic_in_homes(incident_table(spark, sf_dir)))
    assert "Exchange" not in text
    for pushed in (
        "GreaterThan(Year,2000)",
        "Not(EqualTo(Year,2021))",
        "IsNotNull(`FBI Code`)",
        "In(`Location Description`, [APARTMENT,RESIDENCE])",
        "EqualTo(Domestic,true)",
        "GreaterThan(Latitude,40.0)",
        "LessThan(Longitude,-85.0)",
    ):
        assert pushed in text


def test_year_folders_are_pruned(spark, sf_dir, plan):
    text = plan(QUERIES["incidents_domestic_by_year"](spark, sf_dir))
    filters_ = re.search(r"PartitionFilters: (.*)", text).group(1)
    assert "> 2000" in filters_ and "= 2021" in filters_


def test_dates_are_parsed_last(spark, sf_dir, plan):
    text = plan(street_by_day(incident_table(spark, sf_dir)))
    condition = re.search(r"Condition : (.*)", text).group(1)
    assert condition.index("STREET") < condition.index("gettimestamp")


def test_required_columns_restore_pruning(spark, sf_dir, plan):
    slim = domestic_in_homes(incident_table(spark, sf_dir), required=["Latitude", "Longitude"])
    text = plan(slim.select("Latitude", "Longitude"))
    schema = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert "FBI Code" not in schema and "Block" not in schema and schema.count(":") == 6


def test_preview_is_a_bounded_top_k(spark, sf_dir, plan):
    assert "TakeOrderedAndProject" in plan(entry.queries()["preview_rows"](spark, sf_dir))


def test_no_python_workers_in_checked_queries(spark, sf_dir, plan):
    for name in ORACLES:
        text = plan(QUERIES[name](spark, sf_dir))
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def largest_method(spark, df) -> int:
    df.collect()
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
    stages = getattr(debug, "MODULE$").codegenStringSeq(df._jdf.queryExecution().executedPlan())
    assert stages.size() > 0
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))


@pytest.mark.parametrize("ks", [[30], range(3, 10), [100], [300], [1000], [3000]])
def test_scores_of_many_clusters_stay_within_compiled_code(spark, sf_dir, ks):
    """No method of the scoring passes may exceed what the JVM compiles, for any k."""
    points = lineitem_points(spark, sf_dir).withColumns(
        {str(k): F.expr(f"cast(l_extendedprice * 7 as int) % {k}") for k in ks}
    )
    df = silhouette_scores(points, ["l_quantity", "l_extendedprice"], [str(k) for k in ks])
    assert largest_method(spark, df) < 8_000
    found = {r["labelling"]: r["clusters"] for r in df.collect()}
    assert found == {str(k): points.select(str(k)).distinct().count() for k in ks}


def test_assignment_does_not_grow_with_the_centers(spark, sf_dir):
    points = lineitem_points(spark, sf_dir)
    columns = ["l_quantity", "l_extendedprice"]
    sizes = set()
    for k in (5, 30, 300, 1000):
        centers = [(i % 50, 100.0 * i) for i in range(k)]
        sizes.add(largest_method(spark, assign_nearest_center(points, columns, centers)))
    assert len(sizes) == 1 and max(sizes) < 8_000


def test_null_year_is_dropped(spark):
    years = spark.createDataFrame([(None,)], "Year int")
    assert years.filter(filters.year_range()).agg(F.count("*")).first()[0] == 0
