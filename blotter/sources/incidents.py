"""Typed reads of incident files, and staging them as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.schema import INCIDENT_COLUMNS, incident_schema

_REJECTED = "_rejected_record"
_CLEAN, _REJECTS = "clean", "rejects"


def read_incidents(spark: SparkSession, path, codes_as_int: bool = True) -> DataFrame:
    """CSV with a header line, read with the declared schema.

    The schema is positional and nothing is inferred, so the read costs one
    pass. A field that does not fit its type is null (PERMISSIVE mode). Records
    are one line each, which keeps large files splittable.
    """
    return (
        spark.read.schema(incident_schema(codes_as_int))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def count_rejects(spark: SparkSession, path, codes_as_int: bool = True) -> DataFrame:
    """Per typed column, how many present fields do not fit the declared type.

    One pass and one row per column: ``(column_name, rejected)``. The typed read
    itself says which records hold a field it could not convert; only those are
    taken apart again as text, to tell a rejected field from an empty one.
    """
    schema = incident_schema(codes_as_int)
    typed = _typed(schema)
    records = (
        spark.read.schema(schema.add(_REJECTED, T.StringType()))
        .option("header", True)
        .option("columnNameOfCorruptRecord", _REJECTED)
        .csv(path)
        .filter(F.col(_REJECTED).isNotNull())
    )
    as_text = F.from_csv(F.col(_REJECTED), ", ".join(f"`{c}` string" for c in INCIDENT_COLUMNS))
    totals = records.withColumn("text", as_text).selectExpr(
        *[f"count_if(`{c}` is null and text.`{c}` is not null) as `{c}`" for c in typed]
    )
    pairs = [f"struct('{c}' as column_name, `{c}` as rejected)" for c in typed]
    return totals.selectExpr(f"inline(array({', '.join(pairs)}))")


def quarantine_incidents(
    spark: SparkSession, path, folder: str, codes_as_int: bool = True, mode: str = "errorifexists"
) -> None:
    """Read incident files once and write two tables side by side: clean rows, and rejected records.

    A record with a field that does not fit its type is rejected whole, and kept as it stood, with its file and with
    the names and texts of the fields that did not fit. Each task writes what it reads, without a shuffle.
    """
    schema = incident_schema(codes_as_int)
    records = (
        spark.read.schema(schema.add(_REJECTED, T.StringType()))
        .option("header", True)
        .option("columnNameOfCorruptRecord", _REJECTED)
        .csv(path)
        .select("*", F.col("_metadata.file_path").alias("file"))
    )
    as_text = F.from_csv(F.col(_REJECTED), ", ".join(f"`{c}` string" for c in INCIDENT_COLUMNS))
    misfits = [
        F.when(
            F.col(f"`{c}`").isNull() & F.col(f"text.`{c}`").isNotNull(),
            F.struct(F.lit(c).alias("column_name"), F.col(f"text.`{c}`").alias("value")),
        )
        for c in _typed(schema)
    ]
    (
        records.withColumn("text", as_text)
        .withColumn("fields", F.when(F.col(_REJECTED).isNotNull(), F.array_compact(F.array(*misfits))))
        .withColumn("part", F.when(F.col(_REJECTED).isNull(), _CLEAN).otherwise(_REJECTS))
        .select(
            *[F.col(f"`{c}`") for c in INCIDENT_COLUMNS],
            F.col(_REJECTED).alias("record"),
            F.when(F.col(_REJECTED).isNotNull(), F.col("file")).alias("file"),
            "fields",
            "part",
        )
        .write.mode(mode)
        .partitionBy("part")
        .parquet(folder)
    )


def read_quarantined(
    spark: SparkSession, folder: str, codes_as_int: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The clean incidents, and ``(record, file, fields)`` of each rejected record."""
    fields = T.ArrayType(T.StructType().add("column_name", T.StringType()).add("value", T.StringType()))
    schema = incident_schema(codes_as_int).add("record", T.StringType()).add("file", T.StringType())
    both = spark.read.schema(schema.add("fields", fields).add("part", T.StringType())).parquet(folder)
    clean = both.filter(F.col("part") == _CLEAN).select(*[F.col(f"`{c}`") for c in INCIDENT_COLUMNS])
    return clean, both.filter(F.col("part") == _REJECTS).select("record", "file", "fields")


def _typed(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if f.name in INCIDENT_COLUMNS and not isinstance(f.dataType, T.StringType)]


def curve_position(latitude: Column, longitude: Column) -> Column:
    """Place along a space-filling curve (Z-order): the bits of both coordinates in turn.

    Places near one another on the curve are near on the map. Null for a place that is not known.
    """

    def spread(share: Column) -> Column:
        steps = 1 << 24
        bits = F.floor(F.least(F.greatest(share * steps, F.lit(0.0)), F.lit(steps - 1.0))).cast("long")
        # Each step doubles the gaps between the bits, until every other place is free.
        for shift, mask in (
            (16, 0x0000FFFF0000FFFF),
            (8, 0x00FF00FF00FF00FF),
            (4, 0x0F0F0F0F0F0F0F0F),
            (2, 0x3333333333333333),
            (1, 0x5555555555555555),
        ):
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask))
        return bits

    place = F.shiftleft(spread((latitude + 90) / 180), 1).bitwiseOR(spread((longitude + 180) / 360))
    known = [x.isNotNull() & ~F.isnan(x) for x in (latitude, longitude)]
    return F.when(known[0] & known[1], place)


def stage_incidents(
    df: DataFrame,
    path: str,
    by_year: bool = False,
    mode: str = "errorifexists",
    by_place: bool = False,
    files: int | None = None,
) -> None:
    """Write incidents as Parquet, so later scans skip columns and row groups.

    Each task writes what it reads, without a shuffle. ``by_year`` makes one
    folder per Year, which a year filter then prunes, for the price of one
    shuffle: ``rebalance`` gathers each year into few well-sized files, and AQE
    splits a year that holds a large share of the rows.

    ``by_place`` orders incidents along a space-filling curve, within years if there are folders, so the
    statistics of row groups and pages are narrow boxes and a box filter reads only those it meets. It takes a shuffle by
    ranges, into ``files`` of them if given; the ID parts the incidents of one place, so a place with a third of all
    is no hot spot.
    """
    if by_place:
        place = curve_position(F.col("Latitude"), F.col("Longitude"))
        order = ["Year"] * by_year + ["_place", F.xxhash64("ID")]
        placed = df.withColumn("_place", place)
        ranged = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
        df = ranged.sortWithinPartitions(*order[:-1]).drop("_place")
    elif by_year:
        df = df.hint("rebalance", "Year")
    writer = df.write.mode(mode)
    (writer.partitionBy("Year") if by_year else writer).parquet(path)


def read_staged(spark: SparkSession, path: str, codes_as_int: bool = True) -> DataFrame:
    """Staged incidents, their columns in file order either way."""
    staged = spark.read.schema(incident_schema(codes_as_int)).parquet(path)
    return staged.select(*[F.col(f"`{c}`") for c in INCIDENT_COLUMNS])
