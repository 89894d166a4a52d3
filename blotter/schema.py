"""The incident table: one flat table, every field nullable."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names, order and types of the incident file.
INCIDENT_FIELDS = (
    ("ID", T.IntegerType()),
    ("Case Number", T.StringType()),
    ("Date", T.StringType()),
    ("Block", T.StringType()),
    ("IUCR", T.IntegerType()),
    ("Primary Type", T.StringType()),
    ("Description", T.StringType()),
    ("Location Description", T.StringType()),
    ("Arrest", T.BooleanType()),
    ("Domestic", T.BooleanType()),
    ("Beat", T.IntegerType()),
    ("District", T.IntegerType()),
    ("Ward", T.IntegerType()),
    ("Community Area", T.IntegerType()),
    ("FBI Code", T.IntegerType()),
    ("X Coordinate", T.IntegerType()),
    ("Y Coordinate", T.IntegerType()),
    ("Year", T.IntegerType()),
    ("Updated On", T.StringType()),
    ("Latitude", T.DoubleType()),
    ("Longitude", T.DoubleType()),
    ("Location", T.StringType()),
)
CODE_FIELDS = ("IUCR", "FBI Code")
COORDINATES = ("Latitude", "Longitude")

INCIDENT_COLUMNS = tuple(name for name, _ in INCIDENT_FIELDS)


def incident_schema(codes_as_int: bool = True) -> T.StructType:
    """Schema to read incident files with.

    With ``codes_as_int`` the two code fields are integers, so a code such as
    ``031A`` reads as null (and the row later falls to the any-null rule).
    Without it the codes stay text and no row is lost to them.
    """
    return T.StructType(
        [
            T.StructField(
                name,
                T.StringType() if name in CODE_FIELDS and not codes_as_int else kind,
                True,
            )
            for name, kind in INCIDENT_FIELDS
        ]
    )
