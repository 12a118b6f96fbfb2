"""Filter-option lists (O1–O5): distinct values for the selection widgets.

Each list is a distributed ``distinct`` + sort; the caller decides how many
rows to bring to a screen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costmart.functions.textfmt import month_label
from costmart.schema import DEFAULT_COLUMNS, DEFAULT_MAX_DATE, DEFAULT_MIN_DATE, Columns


def date_bounds(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """O1: one row (min_date, max_date); fixed defaults when the table is empty."""
    return df.agg(
        F.coalesce(F.min(cols.date), F.lit(DEFAULT_MIN_DATE).cast("date")).alias("min_date"),
        F.coalesce(F.max(cols.date), F.lit(DEFAULT_MAX_DATE).cast("date")).alias("max_date"),
    )


def month_options(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """O2: sorted distinct month keys with their 'January 2025' label."""
    return (df.select(cols.month_key).distinct()
            .withColumn("label", month_label(cols.month_key, long=True))
            .orderBy(cols.month_key))


def year_options(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """O3: sorted distinct years, as text."""
    return (df.select(F.col(cols.year).cast("int").alias("_y")).distinct()
            .orderBy("_y").select(F.col("_y").cast("string").alias("year")))


def value_options(df: DataFrame, column: str, all_label: str) -> DataFrame:
    """The 'all' entry first, then the sorted distinct non-null values.

    Columns: ``option``, ``is_all``. The order is a distributed sort (range
    partitioning), no single-task window over the distinct values.
    """
    values = (df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("option"))
              .distinct().withColumn("is_all", F.lit(False)))
    everything = df.sparkSession.range(1).select(F.lit(all_label).alias("option"),
                                                 F.lit(True).alias("is_all"))
    return everything.unionByName(values).orderBy(F.desc("is_all"), "option")


def month_label_to_date(label: Column | str) -> Column:
    """O5: 'January 2025' -> 2025-01-01."""
    c = F.col(label) if isinstance(label, str) else label
    return F.to_date(F.concat(F.lit("1 "), c), "d MMMM yyyy")
