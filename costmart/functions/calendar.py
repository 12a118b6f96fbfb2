"""Calendar parts of the transaction time (C5a–C5e). Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costmart.schema import DEFAULT_COLUMNS, Columns


def calendar_columns(ts: Column, cols: Columns = DEFAULT_COLUMNS) -> dict[str, Column]:
    """Date, year, month, day, weekday (Monday = 0), month key, ISO week."""
    day = F.dayofmonth(ts)
    return {
        cols.date: F.to_date(ts),
        cols.year: F.year(ts),
        cols.month: F.month(ts),
        cols.day: day,
        cols.weekday: F.weekday(ts),            # Monday = 0, like pandas' dayofweek
        cols.day_of_month: day,
        cols.month_key: F.date_format(ts, "yyyy-MM"),
        cols.week: F.weekofyear(ts),            # ISO-8601 week number
    }


def with_calendar(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    return df.withColumns(calendar_columns(F.col(cols.time), cols))
