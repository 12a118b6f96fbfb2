"""Text -> typed values for the raw feeds (C2, C3, X5). Column -> Column.

Only ``try_*`` forms are used: under ANSI mode a bad value becomes NULL instead
of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from costmart.schema import FEED_TIME_FORMAT

# A plain decimal number after thousands separators are removed: optional
# sign, digits with an optional fraction (".5" and "5." too), optional
# exponent. Excludes "nan", "inf", "5d", "5f" that a bare cast would accept.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


# One or two digits for day, month, hour and minute, four for the year.
TIME_PATTERN = r"^\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{1,2}\z"


def parse_timestamp(text: Column, fmt: str = FEED_TIME_FORMAT) -> Column:
    """'dd/mm/yyyy HH:MM' text -> timestamp_ntz; unparsable -> NULL.

    Runs of blanks between date and time count as one; single-digit day,
    month, hour and minute are accepted; leading or trailing blanks are not.
    """
    squeezed = F.regexp_replace(text, r"\s+", " ")
    shaped = F.when(text.rlike(TIME_PATTERN), squeezed) if fmt == FEED_TIME_FORMAT else squeezed
    return F.try_to_timestamp(shaped, F.lit(fmt)).cast("timestamp_ntz")


def strip_thousands(text: Column) -> Column:
    return F.regexp_replace(text, ",", "")


def parse_amount(text: Column, precision: int = 18, scale: int = 2) -> Column:
    """'1,234.50' -> decimal; non-numbers, overflow -> NULL."""
    plain = F.regexp_replace(strip_thousands(text), r"^\s+|\s+$", "")
    return F.when(plain.rlike(NUMBER_PATTERN), plain).try_cast(f"decimal({precision},{scale})")
