"""Cleaning the canonical text table into typed transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costmart.functions.calendar import calendar_columns, with_calendar
from costmart.functions.parse import parse_amount, parse_timestamp
from costmart.operators.filters import FilterSpec, filter_predicate
from costmart.schema import DEFAULT_COLUMNS, UNKNOWN, Columns


def is_header_row(cols: Columns = DEFAULT_COLUMNS) -> Column:
    """A header line read as data (its first field is the column name)."""
    return F.coalesce(F.col(cols.transaction) == F.lit(cols.transaction), F.lit(False))


def drop_header_rows(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """C1, applied to every row (a header in any file of a split feed)."""
    return df.where(~is_header_row(cols))


def typed(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """C2 + C3: time and amount parsed; bad values NULL.

    Both come as a generated row: Spark copies no filter on them, nor what is
    made of them, to below it, so each text is parsed once.
    """
    parsed = F.struct(parse_timestamp(F.col(cols.time)).alias(cols.time),
                      parse_amount(F.col(cols.cost)).alias(cols.cost))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (cols.time, cols.cost)]
    return (df.select(*rest, F.inline(F.array(parsed)))
            .select(*(F.col(f"`{c}`") for c in df.columns)))


def default_payer(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """Add the payer column when the *schema* lacks it: the payment source
    if present, else 'Tidak Diketahui'. Rows with a NULL payer stay NULL."""
    if cols.payer in df.columns:
        return df
    fill = F.col(cols.source) if cols.source in df.columns else F.lit(UNKNOWN)
    return df.withColumn(cols.payer, fill)


def clean(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """Drop header rows, type time and amount, drop rows missing either
    (C4), add calendar columns (C5) and the payer default (C6)."""
    out = typed(drop_header_rows(df, cols), cols).na.drop(subset=[cols.time, cols.cost])
    return default_payer(with_calendar(out, cols), cols)


def row_audit(raw: DataFrame, spec: FilterSpec | None = None,
              cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """Raw, clean and filtered row counts in one pass over the raw table
    (and malformed lines, if the feeds were read with ``malformed="mark"``)."""
    t = parse_timestamp(F.col(cols.time))
    valid = (~is_header_row(cols)) & t.isNotNull() & parse_amount(F.col(cols.cost)).isNotNull()
    staged = raw.withColumn("_valid", valid).withColumns(calendar_columns(t, cols))
    staged = default_payer(staged, cols)
    pred = filter_predicate(spec, staged.columns, cols) if spec else None
    kept = F.col("_valid") & (F.coalesce(pred, F.lit(False)) if pred is not None else F.lit(True))
    return staged.agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count_if(F.col("_valid")).alias("n_clean"),
        F.count_if(kept).alias("n_filtered"),
        *([F.count_if("malformed").alias("n_malformed")] if "malformed" in raw.columns else []),
    )
