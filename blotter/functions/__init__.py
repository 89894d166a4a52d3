"""Column functions: text and wall-clock time."""

from blotter.functions.text import field_at, first_token, strip_whitespace
from blotter.functions.wallclock import (
    hour_of_day,
    hour_text,
    parse_day,
    parse_epoch,
)

__all__ = [
    "field_at",
    "first_token",
    "hour_of_day",
    "hour_text",
    "parse_day",
    "parse_epoch",
    "strip_whitespace",
]
