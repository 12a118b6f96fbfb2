"""Ordinal codes of text columns (C7): sorted distinct values -> 0..n-1.

NULL is coded as the text 'nan' (it sorts among the values). Codes are fit on
the whole cleaned table, before any filter, and joined back.

The dense rank is computed without a window over all distinct values (which
would run in one task; doctor names grow with the data): the distinct values
are range-partitioned and sorted, each partition's size is counted, and a
value's code is its partition's offset plus its position in the partition.
Only the offsets (one row per partition and column, a bound set by
configuration) are broadcast. The tagged values are checkpointed to the shared
checkpoint folder so both uses see the same partition numbering. Several
columns are fit in one pass (``fit_all_codes``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costmart.session import ensure_checkpoint_dir

NULL_TEXT = "nan"
#: Rows of a code table that may be broadcast, and salts of the join beyond it.
BROADCAST_CODES, SALTS = 200_000, 16


def code_key(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.cast("string"), F.lit(NULL_TEXT))


def fit_all_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, code) for every distinct value of each column,
    from one pass over ``df`` (NULL -> 'nan')."""
    ensure_checkpoint_dir(df.sparkSession)
    pairs = (df.select(F.explode(F.array(*[
                F.struct(F.lit(c).alias("column_name"), code_key(c).alias("value"))
                for c in columns])).alias("_p"))
             .select("_p.*").distinct())
    tagged = (pairs.repartitionByRange("column_name", "value")
              .sortWithinPartitions("column_name", "value")
              .select("column_name", "value", F.spark_partition_id().alias("_part"),
                      (F.monotonically_increasing_id()
                       - F.shiftleft(F.spark_partition_id().cast("long"), 33)).alias("_pos"))
              .checkpoint())
    # Per (partition, column): how many values, and the position of the first.
    stats = tagged.groupBy("_part", "column_name").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = (Window.partitionBy("column_name").orderBy("_part")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = stats.select("_part", "column_name", "_first",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), ["_part", "column_name"])
            .select("column_name", "value",
                    (F.col("_off") + F.col("_pos") - F.col("_first")).cast("int").alias("code")))


def fit_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code) for every distinct value of ``column`` (NULL -> 'nan')."""
    return fit_all_codes(df, [column]).drop("column_name")


def apply_codes(df: DataFrame, codes: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Add ``<column>_encoded``.

    A code table counted to be of at most ``BROADCAST_CODES`` rows is
    broadcast, so the rows are not shuffled on the column. A larger one is
    joined on the value and a salt: it is repeated ``SALTS`` times, and a hot
    value's rows go to as many tasks.
    """
    out = out or f"{column}_encoded"
    keyed = df.withColumn("_code_key", code_key(column))
    c = codes.withColumnRenamed("value", "_code_key").withColumnRenamed("code", out)
    if c.limit(BROADCAST_CODES + 1).count() <= BROADCAST_CODES:
        return keyed.join(F.broadcast(c), "_code_key", "left").drop("_code_key")
    keyed = keyed.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    c = c.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.join(c, ["_code_key", "_salt"], "left").drop("_code_key", "_salt")


def encode(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Fit codes on ``fit_on`` (default: ``df``) in one pass and add them to ``df``."""
    source = fit_on if fit_on is not None else df
    codes = fit_all_codes(source, columns)
    out = df
    for c in columns:
        one = codes.where(F.col("column_name") == c).drop("column_name")
        out = apply_codes(out, one, c)
    return out
