"""Text functions on columns, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() removes; the last one is U+3000.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip_whitespace(text: Column) -> Column:
    """Drop leading and trailing whitespace of any kind, not spaces only."""
    return F.trim(text, F.lit(WHITESPACE))


def first_token(text: Column, sep: str = " ") -> Column:
    """What precedes the first separator; the whole text if there is none."""
    return F.substring_index(text, sep, 1)


def field_at(text: Column, index: int, sep: str = ",") -> Column:
    """The field at a 0-based position, null where the text has too few.

    Quotes have no meaning here: a quoted separator shifts later fields. The
    split stops after the wanted field, so long tails are never cut up.
    """
    return F.get(F.split(text, _literal(sep), index + 2), F.lit(index))


def _literal(sep: str) -> str:
    return sep if sep in (",", " ", "\t") else rf"\Q{sep}\E"
