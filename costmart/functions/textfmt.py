"""Display formatting as Column expressions (X1–X8); no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rupiah(x: Column | str) -> Column:
    """'Rp 1,234' — thousands separators, no decimals, half-even rounding."""
    return F.concat(F.lit("Rp "), F.format_number(_col(x).cast("double"), 0))


def compact(x: Column | str) -> Column:
    """'Rp 1.2M' for amounts of at least a million, else 'Rp 2K'."""
    v = _col(x).cast("double")
    return F.when(v >= 1e6, F.concat(F.lit("Rp "), F.format_number(v / 1e6, 1), F.lit("M"))) \
        .otherwise(F.concat(F.lit("Rp "), F.format_number(v / 1e3, 0), F.lit("K")))


def truncate(s: Column | str, width: int = 20) -> Column:
    """First ``width`` characters + '...' when longer."""
    c = _col(s)
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))) \
        .otherwise(c)


def month_label(month_key: Column | str, long: bool = False) -> Column:
    """'2025-01' -> 'Jan 2025' (or 'January 2025')."""
    first_day = F.to_date(F.concat(_col(month_key), F.lit("-01")))
    return F.date_format(first_day, "MMMM yyyy" if long else "MMM yyyy")


def count_text(n: Column | str) -> Column:
    """Integer with thousands separators, '1,234'."""
    return F.format_number(_col(n).cast("bigint"), 0)


def abs_error(actual: Column | str, predicted: Column | str) -> Column:
    return F.abs(_col(actual).cast("double") - _col(predicted).cast("double"))

