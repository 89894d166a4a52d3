"""Raw text lines, read without any schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.functions.text import strip_whitespace
from blotter.schema import INCIDENT_COLUMNS


def header_line(columns=INCIDENT_COLUMNS) -> str:
    return ",".join(columns)


def read_lines(spark: SparkSession, path, skip_header: bool = False) -> DataFrame:
    """One row ``value`` per line. The header line counts as data unless skipped.

    A header is one with white space around it, too.
    """
    lines = spark.read.text(path)
    header = strip_whitespace(F.col("value")) == header_line()
    return lines.filter(~header) if skip_header else lines
