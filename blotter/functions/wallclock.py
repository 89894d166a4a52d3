"""Text dates as wall-clock time, independent of the session time zone.

The source writes local wall-clock text without a zone. Read in a zone with
daylight saving, an hour that the zone skips would move; so the text is read as
UTC by the pattern itself, and the hour is cut from the epoch by arithmetic.
Text that does not parse gives null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blotter.functions.text import first_token

# The date patterns of the incident file.
DAY_PATTERN = "MM/dd/yyyy"
STAMP_PATTERN = "MM/dd/yyyy hh:mm:ss a"

_DAY_SECONDS = 86_400
_HOUR_SECONDS = 3_600


def parse_day(text: Column) -> Column:
    """Date of the first token of the text."""
    return F.try_to_date(first_token(text), DAY_PATTERN)


def parse_epoch(text: Column) -> Column:
    """Seconds since 1970 of the wall-clock text (12-hour clock with AM/PM)."""
    stamp = F.try_to_timestamp(F.concat(text, F.lit(" Z")), F.lit(f"{STAMP_PATTERN} XXX"))
    return F.unix_timestamp(stamp)


def hour_text(epoch: Column) -> Column:
    """Hour of day of an epoch as two-digit text."""
    hour = F.floor(F.pmod(epoch, F.lit(_DAY_SECONDS)) / _HOUR_SECONDS)
    return F.lpad(hour.cast("string"), 2, "0")


def hour_of_day(text: Column) -> Column:
    """Hour of day of wall-clock text as two-digit text."""
    return hour_text(parse_epoch(text))
