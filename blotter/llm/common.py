"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.sources.shared import fresh_folder, remove_folder

# Words are maximal runs of anything but the six ASCII white-space characters.
WHITE = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """Write once to the folder all executors share, and read from there.

    Later jobs and retries after a lost executor start from the files.
    """
    folder = fresh_folder(df.sparkSession, purpose)
    df.write.options(**options).parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table.staged_in = folder
    return table


def released(table: DataFrame) -> None:
    """Remove the files of a staged table that nothing reads any more."""
    remove_folder(table.sparkSession, table.staged_in)


def word_array(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), WHITE)
    return F.filter(parts, lambda word: word != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_WHITE)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
