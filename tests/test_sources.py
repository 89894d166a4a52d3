import csv
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from blotter.functions import hour_of_day
from blotter.operators import aggregates, filters
from blotter.operators.columns import with_calendar
from blotter.operators.filters import in_open_box
from blotter.plans import domestic_in_homes, street_at_night
from blotter.schema import INCIDENT_COLUMNS, incident_schema
from blotter.sources import (
    cluster_tiles,
    count_rejects,
    fresh_folder,
    header_line,
    quarantine_incidents,
    read_incidents,
    read_lines,
    read_quarantined,
    read_staged,
    stage_incidents,
    write_cluster_map,
    write_cluster_tiles,
    write_counts,
    write_scores,
)
from blotter.sources.incidents import curve_position
from checks.fixture import incident_view
from checks.registry import SMALL_BOX

# Fields that the golden rows do not vary.
REST = {
    "Block": "001XX W MAIN ST",
    "Primary Type": "THEFT",
    "Description": "OVER $500",
    "Beat": "111",
    "District": "1",
    "Ward": "42",
    "Community Area": "32",
    "X Coordinate": "1176000",
    "Y Coordinate": "1900000",
    "Updated On": "02/10/2018 03:50:01 PM",
}
VARIED = (
    "ID,Case Number,Date,IUCR,Location Description,Arrest,Domestic,FBI Code,Year,"
    "Latitude,Longitude,Location"
).split(",")
GOLDEN = [
    ("1", "A1", "03/11/2007 02:30:00 AM", "0486", "APARTMENT", "false", "true", "08B", "2007", "41.9", "-87.6", '"(41.9, -87.6)"'),
    ("2", "A2", "07/04/2010 11:05:00 PM", "031A", "STREET", "true", "false", "03", "2010", "41.8", "-87.7", '"(41.8, -87.7)"'),
    ("3", "A3", "07/04/2010 12:05:00 AM", "0820", "STREET", "True", "FALSE", "06", "2010", "41.8", "-87.7", '"(41.8, -87.7)"'),
    ("4", "A4", "7/4/2010 6:59:00 AM", "0820", "STREET", "true", "false", "06", "2010", "41.8", "-87.7", '"(41.8, -87.7)"'),
    ("5", "A5", "bad date", "0820", '"BAR, CLUB"', "true", "false", "06", "2010", "", "", ""),
    ("6", "A6", "07/04/2021 10:00:00 PM", "0820", "STREET", "true", "false", "06", "2021", "41.8", "-87.7", '"(41.8, -87.7)"'),
]


@pytest.fixture(scope="module")
def golden_path(tmp_path_factory):
    lines = [header_line()]
    for row in GOLDEN:
        fields = REST | dict(zip(VARIED, row))
        lines.append(",".join(fields[c] for c in INCIDENT_COLUMNS))
    path = tmp_path_factory.mktemp("golden") / "incidents.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture
def golden(spark, golden_path):
    return read_incidents(spark, golden_path)


def ids(df):
    return sorted(r["ID"] for r in df.select("ID").collect())


def test_schema_is_declared_not_inferred(golden):
    assert golden.schema == incident_schema()
    assert [f.dataType.simpleString() for f in golden.schema].count("int") == 10


def test_field_that_does_not_fit_is_null_and_the_row_stays(golden):
    rows = {r["ID"]: r for r in golden.collect()}
    assert len(rows) == 6
    assert rows[1]["FBI Code"] is None and rows[1]["IUCR"] == 486
    assert rows[2]["IUCR"] is None and rows[2]["FBI Code"] == 3
    assert rows[3]["Arrest"] is True and rows[3]["Domestic"] is False
    assert rows[5]["Location Description"] == "BAR, CLUB" and rows[5]["Latitude"] is None


def test_codes_can_stay_text(spark, golden_path):
    rows = {r["ID"]: r for r in read_incidents(spark, golden_path, codes_as_int=False).collect()}
    assert rows[1]["FBI Code"] == "08B" and rows[1]["IUCR"] == "0486"
    complete = filters.drop_any_null(read_incidents(spark, golden_path, codes_as_int=False))
    assert ids(complete) == [1, 2, 3, 4, 6]


def test_any_null_drops_the_row(golden):
    assert ids(filters.drop_any_null(golden)) == [3, 4, 6]


def test_any_null_rule_is_that_of_na_drop(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0), (2, None, 1.0), (3, "c", None), (4, "d", float("nan")), (None, "e", 1.0)],
        "ID int, name string, x double",
    )
    assert ids(filters.drop_any_null(df)) == ids(df.na.drop()) == [1]
    assert ids(filters.drop_any_null(df, ["name", "ID"])) == [1, 3, 4]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_hour_is_wall_clock_in_any_session_zone(golden, in_zone, zone):
    in_zone(zone)
    rows = golden.select("ID", hour_of_day(F.col("Date")).alias("hour")).collect()
    hours = {r["ID"]: r["hour"] for r in rows}
    assert hours == {1: "02", 2: "23", 3: "00", 4: None, 5: None, 6: "22"}


def test_unparsable_dates_give_nulls_not_errors(golden):
    rows = {r["ID"]: r for r in with_calendar(golden).collect()}
    for bad in (4, 5):
        assert [rows[bad][c] for c in ("Day", "Month", "WeekDay", "Year", "hour")] == [None] * 5
    assert (rows[1]["Month"], rows[1]["WeekDay"], rows[1]["Year"]) == (3, 1, 2007)


def test_studies_on_golden_rows(spark, golden, golden_path):
    assert ids(street_at_night(golden)) == [3]
    assert ids(domestic_in_homes(golden)) == []
    text_codes = read_incidents(spark, golden_path, codes_as_int=False)
    assert ids(domestic_in_homes(text_codes)) == [1]
    assert ids(domestic_in_homes(golden, required=["Latitude", "Longitude"])) == [1]


def rejects(spark, path, **options):
    rows = count_rejects(spark, path, **options).collect()
    return {r["column_name"]: r["rejected"] for r in rows if r["rejected"]}


def test_reject_counts(spark, golden_path):
    assert count_rejects(spark, golden_path).count() == 14
    assert rejects(spark, golden_path) == {"IUCR": 1, "FBI Code": 1}
    assert rejects(spark, golden_path, codes_as_int=False) == {}


def test_rejects_are_what_the_reader_rejects(spark, tmp_path):
    """Forms that a cast would take but the file reader does not."""
    row = dict(zip(VARIED, GOLDEN[0])) | REST
    row |= {"FBI Code": "03", "Arrest": "yes", "Beat": " 7", "Ward": "12.0", "Latitude": "north"}
    path = tmp_path / "odd.csv"
    path.write_text(header_line() + "\n" + ",".join(row[c] for c in INCIDENT_COLUMNS) + "\n")
    read = read_incidents(spark, str(path)).first()
    refused = {c for c in ("Arrest", "Beat", "Ward", "Latitude") if read[c] is None}
    assert {"Arrest", "Ward", "Latitude"} <= refused
    assert set(rejects(spark, str(path))) == refused


def test_raw_lines_count_the_header_unless_skipped(spark, golden_path, golden):
    kept = aggregates.count_by_line_field(read_lines(spark, golden_path))
    assert {r["primary_type"]: r["cnt"] for r in kept.collect()} == {"Primary Type": 1, "THEFT": 6}
    skipped = aggregates.count_by_line_field(read_lines(spark, golden_path, skip_header=True))
    typed = aggregates.count_by_primary_type(golden)
    assert sorted(skipped.collect()) == sorted(typed.collect())


def test_staged_parquet_gives_the_same_rows(spark, sf_dir, plan):
    view = incident_view(spark, sf_dir)
    for by_year in (False, True):
        path = fresh_folder(spark, "staged")
        stage_incidents(view, path, by_year=by_year)
        staged = read_staged(spark, path)
        assert staged.columns == list(INCIDENT_COLUMNS)
        assert sorted(map(str, staged.collect())) == sorted(map(str, view.collect()))
    pruned = plan(staged.filter(filters.year_range()))
    assert "PartitionFilters: [isnotnull(Year" in pruned


def test_sinks_round_trip(spark, golden):
    counts = aggregates.count_by_primary_type(golden)
    path = fresh_folder(spark, "counts")
    write_counts(counts, path)
    assert [r["value"] for r in spark.read.text(path).collect()] == ["THEFT\t6"]

    path = fresh_folder(spark, "map")
    write_cluster_map(golden.withColumn("prediction", F.lit(0)), path)
    assert spark.read.parquet(path).columns == ["Longitude", "Latitude", "prediction"]

    path = fresh_folder(spark, "scores")
    write_scores(spark.createDataFrame([(3, 0.5)], "k int, silhouette double"), path)
    assert spark.read.parquet(path).count() == 1


def test_quarantine_keeps_record_file_and_fields(spark, tmp_path):
    """Both tables come from one read; a record with several misfits is one row."""
    names = list(INCIDENT_COLUMNS)
    good = {c: "" for c in names} | {"ID": "1", "Year": "2010"}
    bad = good | {"ID": "2", "Year": "MMX", "Beat": "x9", "Block": "A, B"}
    odd = good | {"ID": "none", "Arrest": "perhaps"}
    for name, rows in {"one": [good, bad], "two": [odd]}.items():
        with open(tmp_path / f"{name}.csv", "w", newline="") as file:
            writer = csv.writer(file)
            writer.writerow(names)
            writer.writerows([row[c] for c in names] for row in rows)
    folder = str(tmp_path / "out")
    quarantine_incidents(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")], folder)
    clean, rejects = read_quarantined(spark, folder)
    assert [r["ID"] for r in clean.collect()] == [1] and clean.columns == names
    found = {r["file"].rsplit("/", 1)[1]: r for r in rejects.collect()}
    assert {tuple(f) for f in found["one.csv"]["fields"]} == {("Year", "MMX"), ("Beat", "x9")}
    assert {tuple(f) for f in found["two.csv"]["fields"]} == {("ID", "none"), ("Arrest", "perhaps")}
    assert '"A, B"' in found["one.csv"]["record"]


def test_curve_order_leaves_out_row_groups(spark, larger_dir, tmp_path):
    """How many row groups can hold points of a box, by the statistics that a scan looks at."""
    view = incident_view(spark, larger_dir)

    def groups(path, box):
        read = total = rows = 0
        for file in Path(path).rglob("*.parquet"):
            held = pq.ParquetFile(file).metadata
            places = {held.schema.column(i).name: i for i in range(held.num_columns)}
            for g in range(held.num_row_groups):
                total += 1
                rows += held.row_group(g).num_rows
                stats = [held.row_group(g).column(places[c]).statistics for c in ("Latitude", "Longitude")]
                read += all(s.has_min_max and s.min < high and s.max > low for s, (low, high) in zip(stats, box))
        return read, total, rows

    plain, curve = str(tmp_path / "plain"), str(tmp_path / "curve")
    stage_incidents(view.repartition(40), plain)
    stage_incidents(view, curve, by_place=True, files=40)
    read, total, rows = groups(plain, SMALL_BOX)
    assert read == total >= 40
    fewer, total, same = groups(curve, SMALL_BOX)
    assert fewer <= total / 4 and total >= 30 and rows == same
    want = view.filter(in_open_box(*SMALL_BOX)).count()
    staged = read_staged(spark, curve).filter(in_open_box(*SMALL_BOX))
    assert staged.count() == want > 0
    largest = max(pq.ParquetFile(f).metadata.num_rows for f in Path(curve).rglob("*.parquet"))
    assert largest < rows / 10  # though two of five incidents are at one place


def test_curve_interleaves_bits(spark):
    rows = [(41.9, -87.6), (-90.0, -180.0), (90.0, 180.0), (None, 1.0), (float("nan"), 1.0), (0.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = [r[0] for r in df.select(curve_position(F.col("a"), F.col("b"))).collect()]

    def plain(lat, lon):
        y, x = (min(int(s * 2**24), 2**24 - 1) for s in ((lat + 90) / 180, (lon + 180) / 360))
        return sum(((y >> i & 1) << (2 * i + 1)) | ((x >> i & 1) << (2 * i)) for i in range(24))

    assert got == [plain(*rows[0]), 0, 2**48 - 1, None, None, plain(0, 0)]


def test_tiles_nest_and_keep_every_incident(spark, tmp_path):
    rows = [(41.9, -87.6, 1), (41.9001, -87.6001, 1), (41.9, -87.6, 2), (-90.0, -180.0, 0), (90.0, 180.0, 0), (None, 1.0, 1), (1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "Latitude double, Longitude double, prediction int")
    tiles = cluster_tiles(df, 9)
    path = str(tmp_path / "tiles")
    write_cluster_tiles(tiles, path)
    found = spark.read.parquet(path)
    assert {r["zoom"]: r["n"] for r in found.groupBy("zoom").agg(F.sum("count").alias("n")).collect()} == {z: 5 for z in range(10)}
    cells = {(r["zoom"], r["x"], r["y"], r["cluster"]): r["count"] for r in found.collect()}
    up = {}
    for (z, x, y, c), n in cells.items():
        if z:
            up[z - 1, x // 2, y // 2, c] = up.get((z - 1, x // 2, y // 2, c), 0) + n
    assert up == {k: n for k, n in cells.items() if k[0] < 9}
    assert cells[9, 0, 511, 0] == cells[9, 511, 0, 0] == 1
    assert cluster_tiles(df.limit(0)).count() == 0
