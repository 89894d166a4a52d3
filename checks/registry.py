"""Every query, with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blotter.functions import (
    field_at,
    first_token,
    hour_of_day,
    parse_day,
    parse_epoch,
    strip_whitespace,
)
from blotter.functions.text import WHITESPACE
from blotter.operators import aggregates, clustering, columns, features, filters, scoring
from blotter.plans import (
    STUDIES,
    assign_gmm,
    assign_kmeans,
    cluster_map,
    domestic_in_homes,
    prepare_points,
    street_at_night,
    street_by_day,
    sweep,
    sweep_from_pool,
)
from blotter.plans.hotspots import GMM_RESTARTS, fit_models
from blotter.schema import COORDINATES, INCIDENT_COLUMNS
from blotter.sources import cluster_tiles, fresh_folder, write_cluster_tiles, write_counts
from checks.fixture import (
    INCIDENT_SQL,
    LINES_SQL,
    PLANTED_SQL,
    TEXT_SQL,
    csv_incidents,
    csv_quarantined,
    csv_rejects,
    incident_table,
    incident_table_by_place,
    incident_table_by_year,
    incident_view,
    lineitem_points,
    planted_points,
    quantity_bucket,
    raw_lines,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn

    return register


def with_incidents(body: str) -> str:
    return f"with {INCIDENT_SQL}{body}"


_ALL = ", ".join(f'"{c}"' for c in INCIDENT_COLUMNS)

# --- sources and sinks ------------------------------------------------------------


@query(with_incidents(f" select {_ALL} from incidents"))
def csv_scan_typed(spark, sf_dir):
    return csv_incidents(spark, sf_dir)


@query(f"with {TEXT_SQL} select {_ALL} from text_view")
def csv_scan_codes_as_text(spark, sf_dir):
    return csv_incidents(spark, sf_dir, codes_as_int=False)


@query(with_incidents(' select "ID", "IUCR", "FBI Code" from incidents'))
def csv_bad_field_to_null(spark, sf_dir):
    return csv_incidents(spark, sf_dir).select("ID", "IUCR", "`FBI Code`")


_TYPED = {
    "ID": "integer", "IUCR": "integer", "Arrest": "boolean", "Domestic": "boolean",
    "Beat": "integer", "District": "integer", "Ward": "integer",
    "Community Area": "integer", "FBI Code": "integer", "X Coordinate": "integer",
    "Y Coordinate": "integer", "Year": "integer", "Latitude": "double",
    "Longitude": "double",
}


@query(
    f"with {TEXT_SQL} "
    + " union all ".join(
        f"select '{c}' as column_name, count(*) filter (where \"{c}\" is not null"
        f' and try_cast(cast("{c}" as varchar) as {kind}) is null) as rejected from text_view'
        for c, kind in _TYPED.items()
    )
)
def csv_reject_counts(spark, sf_dir):
    return csv_rejects(spark, sf_dir)


_MISFITS = " union all ".join(
    f"select event_id as event, '{c}' as column_name, cast(\"{c}\" as varchar) as value from text_view"
    f' where "{c}" is not null and try_cast(cast("{c}" as varchar) as {kind}) is null'
    for c, kind in _TYPED.items()
)


@query(
    f"with {LINES_SQL}, misfits as ({_MISFITS}) select line as record, column_name, misfits.value"
    " from misfits join file_lines on event_id = event"
)
def csv_rejected_records(spark, sf_dir):
    """Every field that did not fit, with its whole record as it stands in the file."""
    _, rejects = csv_quarantined(spark, sf_dir)
    return rejects.select("record", F.inline("fields"))


@query(
    with_incidents(
        f", misfits as ({_MISFITS}) select {_ALL} from incidents anti join misfits on \"ID\" = event"
    )
)
def csv_clean_rows(spark, sf_dir):
    """The rows written beside them, in the same read."""
    clean, _ = csv_quarantined(spark, sf_dir)
    return clean


@query(f"with {LINES_SQL} select value from lines")
def text_line_scan(spark, sf_dir):
    return raw_lines(spark, sf_dir)


@query(with_incidents(f' select {_ALL} from incidents order by "ID" limit 20'))
def preview_rows(spark, sf_dir):
    return columns.preview(incident_view(spark, sf_dir))


@query("select event_type as primary_type, count(*) as cnt from events group by 1")
def key_count_sink(spark, sf_dir):
    path = fresh_folder(spark, "counts")
    write_counts(aggregates.count_by_primary_type(incident_view(spark, sf_dir)), path)
    return spark.read.csv(path, sep="\t", schema="primary_type string, cnt bigint")


# --- projections ------------------------------------------------------------------


@query(with_incidents(' select "Longitude", "Latitude" from incidents'))
def project_columns(spark, sf_dir):
    return incident_view(spark, sf_dir).select("Longitude", "Latitude")


# Text dates as the parser must meet them: fit, absent, junk, unpadded, impossible.
_MESSY = (
    "case when ID % 97 = 0 then 'bad date' when ID % 89 = 0 then null"
    " when ID % 83 = 0 then '7/4/2010 6:59:00 AM'"
    " when ID % 79 = 0 then '13/31/2010 11:05:00 PM'"
    " when ID % 73 = 0 then substring(Date, 1, 10) || ' noon' else Date end"
)
_MESSY_SQL = with_incidents(f', messy as (select "ID", {_MESSY} as "Date" from incidents)')
_DAY_SQL = (
    "case when regexp_full_match(split_part(\"Date\", ' ', 1), '\\d{2}/\\d{2}/\\d{4}')"
    " then cast(try_strptime(split_part(\"Date\", ' ', 1), '%m/%d/%Y') as date) end"
)
_STAMP_SQL = (
    "case when regexp_full_match(\"Date\","
    " '\\d{2}/\\d{2}/\\d{4} \\d{2}:\\d{2}:\\d{2} [AP]M')"
    " then try_strptime(\"Date\", '%m/%d/%Y %I:%M:%S %p') end"
)


def messy_dates(spark, sf_dir):
    return incident_view(spark, sf_dir).selectExpr("ID", f"{_MESSY} as Date")


_CALENDAR_SQL = f"""cast(month({_DAY_SQL}) as integer) as "Month",
 cast(dayofweek({_DAY_SQL}) + 1 as integer) as "WeekDay",
 cast(year({_DAY_SQL}) as integer) as "Year",
 strftime({_STAMP_SQL}, '%H') as hour"""


@query(f'{_MESSY_SQL} select "ID", "Date", {_DAY_SQL} as "Day", {_CALENDAR_SQL} from messy')
def calendar_columns(spark, sf_dir):
    return columns.with_calendar(messy_dates(spark, sf_dir)).select(
        "ID", "Date", "Day", "Month", "WeekDay", "Year", "hour"
    )


@query(
    with_incidents(
        f' select "ID", cast(year({_DAY_SQL}) as integer) as "Year" from incidents'
    )
)
def overwrite_column(spark, sf_dir):
    return columns.with_calendar(incident_view(spark, sf_dir)).select("ID", "Year")


_DATED = (
    f', dated as (select * exclude ("Year"), "Year" as file_year, {_CALENDAR_SQL}'
    " from incidents)"
)
_KEPT = ", ".join(f'"{c}"' for c in INCIDENT_COLUMNS if c != "Date")


@query(with_incidents(f'{_DATED} select {_KEPT}, "Month", "WeekDay", hour from dated'))
def drop_columns(spark, sf_dir):
    return columns.without_dates(columns.with_calendar(incident_view(spark, sf_dir)))


# --- filters ----------------------------------------------------------------------

_YEARS = '"Year" > 2000 and "Year" <> 2021'
_BOX = (
    '"Latitude" > 40 and "Latitude" < 45 and "Longitude" > -90 and "Longitude" < -85'
)
_HOMES = "\"Location Description\" in ('APARTMENT', 'RESIDENCE')"
_STREET = "\"Location Description\" = 'STREET'"
_NIGHT = "(cast(hour as integer) >= 22 or cast(hour as integer) <= 6)"
_DAY = "cast(hour as integer) < 22 and cast(hour as integer) > 6"
_FULL = " and ".join(f'"{c}" is not null' for c in INCIDENT_COLUMNS)


@query(with_incidents(f" select {_ALL} from incidents where {_YEARS}"))
def filter_year_range(spark, sf_dir):
    return incident_table(spark, sf_dir).filter(filters.year_range())


@query(with_incidents(f" select {_ALL} from incidents where {_FULL}"))
def drop_any_null(spark, sf_dir):
    return filters.drop_any_null(incident_table(spark, sf_dir))


@query(with_incidents(f" select {_ALL} from incidents where {_HOMES}"))
def filter_location_in(spark, sf_dir):
    return incident_table(spark, sf_dir).filter(filters.place_in(*filters.HOME_PLACES))


@query(with_incidents(f" select {_ALL} from incidents where {_STREET}"))
def filter_location_eq(spark, sf_dir):
    return incident_table(spark, sf_dir).filter(filters.place_is(filters.STREET_PLACE))


@query(with_incidents(f' select {_ALL} from incidents where "Domestic"'))
def filter_flag(spark, sf_dir):
    return incident_table(spark, sf_dir).filter(filters.is_domestic())


@query(with_incidents(f" select {_ALL} from incidents where {_BOX}"))
def filter_bbox(spark, sf_dir):
    return incident_table(spark, sf_dir).filter(filters.in_open_box())


@query(with_incidents(f" select {_ALL} from incidents where {_BOX}"))
def filter_bbox_by_place(spark, sf_dir):
    """The same on incidents staged along a curve over the map: whole row groups are left out."""
    return incident_table_by_place(spark, sf_dir).filter(filters.in_open_box())


# Some of the places, so most row groups of a table in the order of the curve are outside.
SMALL_BOX = ((41.675, 41.805), (-87.745, -87.605))


@query(
    with_incidents(
        f" select {_ALL} from incidents where \"Latitude\" > {SMALL_BOX[0][0]} and \"Latitude\" < {SMALL_BOX[0][1]}"
        f' and "Longitude" > {SMALL_BOX[1][0]} and "Longitude" < {SMALL_BOX[1][1]}'
    )
)
def filter_small_box_by_place(spark, sf_dir):
    return incident_table_by_place(spark, sf_dir).filter(filters.in_open_box(*SMALL_BOX))


_HOURS_SQL = f", hours as (select \"ID\", strftime({_STAMP_SQL}, '%H') as hour from messy)"


@query(f"{_MESSY_SQL}{_HOURS_SQL} select \"ID\", hour from hours where {_NIGHT}")
def filter_night(spark, sf_dir):
    dated = messy_dates(spark, sf_dir).select("ID", hour_of_day(F.col("Date")).alias("hour"))
    return dated.filter(filters.at_night())


@query(f"{_MESSY_SQL}{_HOURS_SQL} select \"ID\", hour from hours where {_DAY}")
def filter_day(spark, sf_dir):
    dated = messy_dates(spark, sf_dir).select("ID", hour_of_day(F.col("Date")).alias("hour"))
    return dated.filter(filters.by_day())


def _study_sql(where: str, selected: str = f'{_KEPT}, "Month", "WeekDay", hour') -> str:
    complete = f", complete as (select * from incidents where {_YEARS} and {_FULL})"
    return with_incidents(
        complete
        + _DATED.replace("from incidents", "from complete")
        + f" select {selected} from dated where hour is not null and {where}"
    )


_DOMESTIC = f'{_HOMES} and "Domestic" and {_BOX}'


@query(_study_sql(_DOMESTIC))
def incidents_domestic(spark, sf_dir):
    return domestic_in_homes(incident_table(spark, sf_dir))


@query(_study_sql(_DOMESTIC))
def incidents_domestic_by_year(spark, sf_dir):
    return domestic_in_homes(incident_table_by_year(spark, sf_dir))


@query(_study_sql(f"{_STREET} and {_BOX} and {_NIGHT}"))
def incidents_street_night(spark, sf_dir):
    return street_at_night(incident_table(spark, sf_dir))


@query(_study_sql(f"{_STREET} and {_BOX} and {_DAY}"))
def incidents_street_day(spark, sf_dir):
    return street_by_day(incident_table(spark, sf_dir))


@query(_study_sql(_DOMESTIC))
def incidents_domestic_from_csv(spark, sf_dir):
    return domestic_in_homes(csv_incidents(spark, sf_dir))


# --- aggregations -----------------------------------------------------------------


@query("select event_type as primary_type, count(*) as cnt from events group by 1")
def count_by_primary_type(spark, sf_dir):
    return aggregates.count_by_primary_type(incident_view(spark, sf_dir))


@query("select o_orderpriority as priority, count(*) as cnt from orders group by 1")
def count_by_priority(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return aggregates.count_by(orders, "o_orderpriority", "priority")


def _sql_text(text: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in text)


_TRIMMED = f", trimmed as (select trim(value, {_sql_text(WHITESPACE)}) as line from lines)"
_FIELD_5 = "string_split(line, ',')[6]"


@query(
    f"with {LINES_SQL}{_TRIMMED} select {_FIELD_5} as primary_type, count(*) as cnt"
    " from trimmed group by 1"
)
def count_by_field_raw_lines(spark, sf_dir):
    return aggregates.count_by_line_field(raw_lines(spark, sf_dir))


@query(
    f"with {LINES_SQL}{_TRIMMED} select {_FIELD_5} as primary_type, count(*) as cnt"
    f" from trimmed where line <> '{','.join(INCIDENT_COLUMNS)}' group by 1"
)
def count_by_field_skip_header(spark, sf_dir):
    return aggregates.count_by_line_field(raw_lines(spark, sf_dir, skip_header=True))


@query(
    _study_sql(
        _DOMESTIC,
        'round(stddev_samp("Latitude"), 6) as "Latitude",'
        ' round(stddev_samp("Longitude"), 6) as "Longitude"',
    )
)
def coordinate_stddev(spark, sf_dir):
    spread = aggregates.column_stddev(
        domestic_in_homes(incident_table(spark, sf_dir)), COORDINATES
    )
    return spread.select(*[F.round(c, 6).alias(c) for c in COORDINATES])


@query(
    with_incidents(
        ' select count("Latitude") as rows, round(avg("Latitude"), 6) as mean,'
        ' round(stddev_samp("Latitude"), 6) as stddev from incidents where "Latitude" is not null'
    )
)
def merged_moments(spark, sf_dir):
    """Spread from the moments of each year, kept apart and then merged: no row is read twice."""
    incidents = incident_table(spark, sf_dir).filter("Latitude is not null")
    per_year = features.column_moments(incidents, ["Latitude"], by=["Year"])
    whole = features.merge_moments(per_year, ["Latitude"])
    (stddev,) = features.moments_stddev(whole, ["Latitude"])
    return whole.select(
        F.col("rows").cast("long").alias("rows"),
        F.round("mean_Latitude", 6).alias("mean"),
        F.round(stddev, 6).alias("stddev"),
    )


# --- scalar functions -------------------------------------------------------------


@query(f"{_MESSY_SQL} select \"ID\", split_part(\"Date\", ' ', 1) as day_text from messy")
def split_date_part(spark, sf_dir):
    return messy_dates(spark, sf_dir).select("ID", first_token(F.col("Date")).alias("day_text"))


@query(f"with {LINES_SQL} select string_split(value, ',')[6] as field from lines")
def split_field_at(spark, sf_dir):
    return raw_lines(spark, sf_dir).select(field_at(F.col("value"), 5).alias("field"))


@query(f"with {LINES_SQL}{_TRIMMED} select line from trimmed")
def trim_line(spark, sf_dir):
    return raw_lines(spark, sf_dir).select(strip_whitespace(F.col("value")).alias("line"))


@query(f'{_MESSY_SQL} select "ID", {_DAY_SQL} as day from messy')
def parse_date(spark, sf_dir):
    return messy_dates(spark, sf_dir).select("ID", parse_day(F.col("Date")).alias("day"))


@query(
    f'{_MESSY_SQL} select "ID", cast(epoch({_STAMP_SQL}) as bigint) as seconds from messy',
    name="parse_epoch",
)
def parse_epoch_seconds(spark, sf_dir):
    return messy_dates(spark, sf_dir).select("ID", parse_epoch(F.col("Date")).alias("seconds"))


@query(
    f"{_MESSY_SQL} select \"ID\", strftime({_STAMP_SQL}, '%H') as hour from messy",
    name="hour_of_day",
)
def hour_of_day_text(spark, sf_dir):
    return messy_dates(spark, sf_dir).select("ID", hour_of_day(F.col("Date")).alias("hour"))


@query(
    'select o_orderkey, cast(month(o_orderdate) as integer) as "Month",'
    ' cast(dayofweek(o_orderdate) + 1 as integer) as "WeekDay",'
    " cast(year(o_orderdate) as integer) as \"Year\", strftime(o_orderdate, '%H') as hour"
    " from orders"
)
def calendar_columns_orders(spark, sf_dir):
    text = F.date_format("o_orderdate", "MM/dd/yyyy hh:mm:ss a").alias("Date")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text)
    return columns.with_calendar(orders).drop("Date", "Day")


# --- features ---------------------------------------------------------------------


def _vector_parts(df: DataFrame, vector: str, digits: int | None = None) -> DataFrame:
    parts = vector_to_array(F.col(vector))
    named = {"latitude": F.get(parts, F.lit(0)), "longitude": F.get(parts, F.lit(1))}
    return df.select(
        "ID",
        *[(F.round(v, digits) if digits else v).alias(n) for n, v in named.items()],
    )


@query(_study_sql(_DOMESTIC, '"ID", "Latitude" as latitude, "Longitude" as longitude'))
def assemble_features(spark, sf_dir):
    incidents = domestic_in_homes(incident_table(spark, sf_dir))
    return _vector_parts(features.assemble_features(incidents), features.FEATURES)


_STANDARDIZED_SQL = _study_sql(
    _DOMESTIC,
    '"ID", round("Latitude" / stddev_samp("Latitude") over (), 6) as latitude,'
    ' round("Longitude" / stddev_samp("Longitude") over (), 6) as longitude',
)


@query(_STANDARDIZED_SQL)
def standardize_features(spark, sf_dir):
    assembled = features.assemble_features(domestic_in_homes(incident_table(spark, sf_dir)))
    scaled = features.standardize_features(assembled, features.fit_scaler(assembled))
    return _vector_parts(scaled, features.STANDARDIZED, 6)


@query(_STANDARDIZED_SQL)
def standardize_weighted_points(spark, sf_dir):
    """The same result by the path the studies use: scale from collapsed points."""
    incidents = domestic_in_homes(incident_table(spark, sf_dir))
    scale = features.measure_scale(features.collapse_points(incidents))
    scaled = features.standardize_columns(incidents, scale)
    return _vector_parts(scaled, features.STANDARDIZED, 6)


@query(
    _study_sql(
        _DOMESTIC, '"Latitude", "Longitude", count(*) as weight'
    ) + ' group by "Latitude", "Longitude"'
)
def collapse_points(spark, sf_dir):
    return features.collapse_points(domestic_in_homes(incident_table(spark, sf_dir)))


# --- clustering with given centers or labels: checked by value --------------------

# Centers on a coarse lattice, so points fall between them and some are tied.
CENTERS = [(41.65, -87.85), (41.75, -87.75), (41.85, -87.65), (41.95, -87.55), (41.75, -87.65)]


def _center_sql(selected: str, centers=CENTERS) -> str:
    distances = ", ".join(
        f'("Latitude" - ({lat}::double)) * ("Latitude" - ({lat}::double))'
        f' + ("Longitude" - ({lon}::double)) * ("Longitude" - ({lon}::double))'
        for lat, lon in centers
    )
    found = f"list_position([{distances}], list_min([{distances}]))"
    return _study_sql(_DOMESTIC, f'{selected}, cast({found} - 1 as integer) as prediction')


@query(_center_sql('"ID"'))
def assign_nearest_center(spark, sf_dir):
    incidents = domestic_in_homes(incident_table(spark, sf_dir))
    return clustering.assign_nearest_center(incidents, COORDINATES, CENTERS).select(
        "ID", "prediction"
    )


@query(_center_sql('"Longitude", "Latitude"'))
def cluster_map_points(spark, sf_dir):
    incidents = domestic_in_homes(incident_table(spark, sf_dir))
    return cluster_map(clustering.assign_nearest_center(incidents, COORDINATES, CENTERS))


# Zooms of the tiles that are checked.
TILE_ZOOM = 12


@query(
    f"""with mapped as ({_center_sql('"Longitude", "Latitude"')}),
finest as (select cast(least(floor(("Longitude" + 180) / 360 * {1 << TILE_ZOOM}), {(1 << TILE_ZOOM) - 1}) as bigint) as x,
  cast(least(floor((90 - "Latitude") / 180 * {1 << TILE_ZOOM}), {(1 << TILE_ZOOM) - 1}) as bigint) as y,
  prediction as cluster from mapped)
select cast(zoom as integer) as zoom, x >> ({TILE_ZOOM} - zoom) as x, y >> ({TILE_ZOOM} - zoom) as y, cluster, count(*) as count
from finest, range({TILE_ZOOM + 1}) t(zoom) group by 1, 2, 3, 4"""
)
def cluster_map_tiles(spark, sf_dir):
    incidents = domestic_in_homes(incident_table(spark, sf_dir))
    mapped = clustering.assign_nearest_center(incidents, COORDINATES, CENTERS)
    path = fresh_folder(spark, "tiles")
    write_cluster_tiles(cluster_tiles(mapped, TILE_ZOOM), path)
    return spark.read.parquet(path)


_POINT = ("l_quantity", "l_extendedprice")


_BUCKET = "cast(floor((l_quantity - 1) * {k} / 50) as integer)"


def _silhouette_sql(ks, label: str = _BUCKET) -> str:
    """Labels are k equal quantity buckets; same sums, written as a self-free join."""
    labelled = " union all ".join(
        f"select {k} as k, {label.format(k=k)} as label,"
        " l_quantity as x, l_extendedprice as y from lineitem"
        for k in ks
    )
    return f"""labelled as ({labelled}),
sums as (select k, label, count(*) as n, sum(x) as sx, sum(y) as sy,
  sum(x * x + y * y) as sq from labelled group by 1, 2),
paired as (select p.k, p.label, p.rid, s.n, s.label as other,
  p.x * p.x + p.y * p.y + s.sq / s.n - 2 * (p.x * s.sx + p.y * s.sy) / s.n as d
  from (select *, row_number() over () as rid from labelled) p join sums s on s.k = p.k),
ab as (select k, rid, max(case when other = label then n end) as n,
  max(case when other = label then d * n / nullif(n - 1, 0) end) as a,
  min(case when other <> label then d end) as b from paired group by 1, 2),
scores as (select k, avg(case when n = 1 then 0 when a < b then 1 - a / b
  when a > b then b / a - 1 else 0 end) as silhouette from ab group by 1)"""


def _bucket_scores(spark, sf_dir, ks) -> DataFrame:
    points = lineitem_points(spark, sf_dir)
    labelled = points.withColumns({str(k): quantity_bucket(k) for k in ks})
    scores = scoring.silhouette_scores(labelled, _POINT, [str(k) for k in ks])
    return scores.select(F.col("labelling").cast("int").alias("k"), "silhouette")


@query(f"with {_silhouette_sql([4])} select round(silhouette, 6) as silhouette from scores")
def silhouette_score(spark, sf_dir):
    return _bucket_scores(spark, sf_dir, [4]).select(
        F.round("silhouette", 6).alias("silhouette")
    )


# Hundreds of clusters: quantity by price band.
_MANY_LABEL = "cast(l_quantity as int) * 10 + cast(floor(l_extendedprice / 10000) as int)"


@query(f"with {_silhouette_sql([1], _MANY_LABEL)} select round(silhouette, 6) as silhouette from scores")
def silhouette_many_clusters(spark, sf_dir):
    points = lineitem_points(spark, sf_dir).withColumn("label", F.expr(_MANY_LABEL))
    return scoring.silhouette_scores(points, _POINT, ["label"]).select(
        F.round("silhouette", 6).alias("silhouette")
    )


# A lattice of centers finer than the places, in the hundreds.
MANY_CENTERS = [(41.6 + i * 0.021, -87.9 + j * 0.019) for i in range(20) for j in range(20)]


@query(_center_sql('"ID"', MANY_CENTERS))
def assign_many_centers(spark, sf_dir):
    incidents = domestic_in_homes(incident_table(spark, sf_dir))
    return clustering.assign_nearest_center(incidents, COORDINATES, MANY_CENTERS).select(
        "ID", "prediction"
    )


_SCORE_KS = STUDIES["domestic_kmeans_3_to_9"].ks


@query(
    f"with {_silhouette_sql(_SCORE_KS)} select cast(k as integer) as k,"
    " round(silhouette, 6) as silhouette from scores"
)
def score_by_k(spark, sf_dir):
    return _bucket_scores(spark, sf_dir, _SCORE_KS).select(
        "k", F.round("silhouette", 6).alias("silhouette")
    )


@query(
    f"with {_silhouette_sql(_SCORE_KS)} select cast(k as integer) as k,"
    " round(silhouette, 6) as silhouette from scores order by scores.silhouette desc limit 1"
)
def best_k(spark, sf_dir):
    best = scoring.best_k(_bucket_scores(spark, sf_dir, _SCORE_KS))
    return best.select("k", F.round("silhouette", 6).alias("silhouette"))


# --- fitted models on planted groups: SQL by group says what the fit must find ----

# Clusters are numbered by their latitude, as fits number them at random.
_BY_GROUP = f"""with {PLANTED_SQL},
found as (select planted, cast(row_number() over (order by avg("Latitude")) - 1 as integer) as cluster,
  avg("Latitude") as lat, avg("Longitude") as lon, count(*) as size from planted_points group by planted)"""


def _numbered(centers: DataFrame) -> DataFrame:
    """Fitted clusters with their number in order of latitude."""
    order = Window.orderBy("Latitude")
    return centers.withColumn("number", F.row_number().over(order) - 1)


@query(
    f'{_BY_GROUP} select cluster, round(lat, 6) as "Latitude", round(lon, 6) as "Longitude",'
    " size from found"
)
def planted_kmeans_fit(spark, sf_dir):
    with prepare_points(planted_points(spark, sf_dir)) as points:
        centers = clustering.kmeans_centers(fit_models(points, [3])[3], points.frame, points.scale)
    return _numbered(centers).select(
        F.col("number").alias("cluster"), *[F.round(c, 6).alias(c) for c in COORDINATES], "size"
    )


def _assigned(assigned: DataFrame, *selected: str) -> DataFrame:
    """Assignments by number; a cluster's order is that of its mean latitude."""
    means = assigned.groupBy("prediction").agg(F.avg("Latitude").alias("Latitude"))
    numbers = _numbered(means).select("prediction", "number")
    return assigned.join(numbers, "prediction").select(
        *selected, F.col("number").alias("prediction")
    )


_EVERY_POINT = f"{_BY_GROUP} select {{}}, cluster as prediction from planted_points join found using (planted)"


@query(_EVERY_POINT.format('"ID"'))
def planted_kmeans_predict(spark, sf_dir):
    return _assigned(assign_kmeans(planted_points(spark, sf_dir), 3), "ID")


@query(_EVERY_POINT.format('"Longitude", "Latitude"'))
def planted_cluster_map(spark, sf_dir):
    mapped = cluster_map(assign_kmeans(planted_points(spark, sf_dir), 3))
    return _assigned(mapped, "Longitude", "Latitude")


@query(_EVERY_POINT.format('"ID"'))
def planted_gmm_predict(spark, sf_dir):
    return _assigned(assign_gmm(planted_points(spark, sf_dir), 3, restarts=GMM_RESTARTS), "ID")


@query(
    f"{_BY_GROUP} select cluster, round(size / sum(size) over (), 4) as mixing_weight,"
    ' round(lat, 4) as "Latitude", round(lon, 4) as "Longitude" from found'
)
def planted_gmm_fit(spark, sf_dir):
    with prepare_points(planted_points(spark, sf_dir)) as points:
        model = fit_models(points, [3], "gmm", restarts=GMM_RESTARTS)[3]
    found = _numbered(clustering.gmm_components(spark, model, points.scale))
    return found.select(
        F.col("number").alias("cluster"),
        *[F.round(c, 4).alias(c) for c in ("mixing_weight", *COORDINATES)],
    )


_PLANTED_SCORE = f"""with {PLANTED_SQL},
scaled as (select planted as label, "Latitude" / stddev_samp("Latitude") over () as x,
  "Longitude" / stddev_samp("Longitude") over () as y from planted_points),
middle as (select label, x - avg(x) over () as x, y - avg(y) over () as y, row_number() over () as rid from scaled),
sums as (select label, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x + y * y) as sq from middle group by 1),
paired as (select p.rid, p.label, s.label as other, s.n,
  p.x * p.x + p.y * p.y + s.sq / s.n - 2 * (p.x * s.sx + p.y * s.sy) / s.n as d from middle p, sums s),
ab as (select rid, max(case when other = label then d * n / (n - 1) end) as a,
  min(case when other <> label then d end) as b from paired group by rid)
select 3 as k, round(avg((b - a) / greatest(a, b)), 6) as silhouette from ab"""


@query(_PLANTED_SCORE)
def planted_best_k(spark, sf_dir):
    scores = sweep(planted_points(spark, sf_dir), [2, 3, 4, 5])
    best = scoring.best_k(scores)
    return best.select("k", F.round("silhouette", 6).alias("silhouette"))


@query(_PLANTED_SCORE)
def planted_best_k_from_pool(spark, sf_dir):
    scores = sweep_from_pool(planted_points(spark, sf_dir), [2, 3, 4, 5])
    best = scoring.best_k(scores)
    return best.select("k", F.round("silhouette", 6).alias("silhouette"))


# --- fitted models on the studies: checked by invariants in the tests -------------


@query()
def kmeans_fit(spark, sf_dir):
    with prepare_points(domestic_in_homes(incident_table(spark, sf_dir))) as points:
        model = fit_models(points, [3])[3]
        return clustering.kmeans_centers(model, points.frame, points.scale)


@query()
def kmeans_predict(spark, sf_dir):
    incidents = domestic_in_homes(incident_table(spark, sf_dir))
    return assign_kmeans(incidents, 3).select("ID", *COORDINATES, "prediction")


@query(_study_sql(_DOMESTIC, '"ID", true as nearest'))
def kmeans_predict_nearest(spark, sf_dir):
    """Whether each incident's cluster is that of the nearest of the centers returned."""
    incidents = domestic_in_homes(incident_table(spark, sf_dir))
    with prepare_points(incidents) as points:
        model, scale = fit_models(points, [3])[3].setPredictionCol("prediction"), points.scale
    assigned = model.transform(features.standardize_columns(incidents, scale))
    centers = [[float(x) for x in center] for center in model.clusterCenters()]
    scaled = {f"scaled_{i}": x for i, x in enumerate(scale.scaled())}
    nearest = clustering.nearest_center(list(scaled), centers)
    return assigned.withColumns(scaled).select("ID", (F.col("prediction") == nearest).alias("nearest"))


@query()
def gmm_fit(spark, sf_dir):
    with prepare_points(domestic_in_homes(incident_table(spark, sf_dir))) as points:
        model = fit_models(points, [3], "gmm", restarts=GMM_RESTARTS)[3]
    return clustering.gmm_components(spark, model, points.scale)


@query()
def gmm_predict(spark, sf_dir):
    incidents = domestic_in_homes(incident_table(spark, sf_dir))
    assigned = assign_gmm(incidents, 3, restarts=GMM_RESTARTS)
    return assigned.select(
        "ID", *COORDINATES, "prediction", vector_to_array("probability").alias("probability")
    )


def _study(spark, sf_dir, name: str) -> DataFrame:
    study = STUDIES[name]
    return sweep(study.select(incident_table(spark, sf_dir)), study.ks, study.algorithm)


@query()
def kmeans_k_sweep(spark, sf_dir):
    return _study(spark, sf_dir, "domestic_kmeans_3_to_9")


@query()
def kmeans_k_sweep_from_pool(spark, sf_dir):
    study = STUDIES["domestic_kmeans_3_to_9"]
    return sweep_from_pool(study.select(incident_table(spark, sf_dir)), study.ks)


@query()
def gmm_k_sweep(spark, sf_dir):
    return _study(spark, sf_dir, "domestic_gmm_3_to_9")


@query()
def domestic_kmeans_3(spark, sf_dir):
    return _study(spark, sf_dir, "domestic_kmeans_3")


@query()
def domestic_kmeans_30(spark, sf_dir):
    return _study(spark, sf_dir, "domestic_kmeans_30")


@query()
def street_night_k_sweep(spark, sf_dir):
    return _study(spark, sf_dir, "street_night_kmeans_3_to_9")


@query()
def street_day_kmeans_30(spark, sf_dir):
    return _study(spark, sf_dir, "street_day_kmeans_30")
