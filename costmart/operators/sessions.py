"""Sessions of rows less than a gap apart, over a whole table.

The rows are dealt by range over (keys, time), so a key that holds a third of
all rows is cut into parts; the last time and the number of sessions of the
parts before are carried, one row per part. The form for streams is
``streaming.eventtime.run_sessions``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costmart.operators.ordered import PART, _carried, split_ordered
from costmart.session import materialise


def number_sessions(df: DataFrame, keys: Sequence[str], time: str, tie_break: str,
                    gap_seconds: int, name: str = "session", parts: int | None = None) -> DataFrame:
    """``df`` with the number (from 1, per key) of the session a row belongs to.

    A row begins a session if the row before it is at least the gap away. Rows
    without a time have no session (NULL); null keys are a key like any other.
    """
    timed = df.where(F.col(time).isNotNull()).withColumn(
        "_at", F.unix_micros(F.col(time).cast("timestamp")))
    dealt = split_ordered(timed, keys, ["_at", tie_break], parts)
    along = Window.partitionBy(PART, *keys).orderBy("_at", tie_break)
    before = F.coalesce(F.lag("_at").over(along), F.col("_carry"))
    far = before.isNull() | (F.col("_at") - before >= gap_seconds * 1_000_000)
    marked = _carried(dealt, keys, F.max("_at"), F.max).withColumn("_first", far.cast("long"))
    # Read twice below, and the windows would be evaluated twice.
    marked = materialise(marked.drop("_carry"), "session-starts")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = _carried(marked, keys, F.sum("_first"), F.sum).withColumn(
        name, F.sum("_first").over(so_far) + F.coalesce("_carry", F.lit(0)))
    return found.select(*df.columns, name).unionByName(
        df.where(F.col(time).isNull()).withColumn(name, F.lit(None).cast("long")))


def sessions(df: DataFrame, keys: Sequence[str], time: str, tie_break: str, gap_seconds: int,
             aggregates: Sequence[Column], parts: int | None = None) -> DataFrame:
    """One row per key and session: keys, session, session_start, session_end (last time plus
    gap), aggregates. A session of very many rows is summed in each task first."""
    numbered = number_sessions(df, keys, time, tie_break, gap_seconds, parts=parts)
    return numbered.where(F.col("session").isNotNull()).groupBy(*keys, "session").agg(
        F.min(time).alias("session_start"),
        (F.max(time) + F.expr(f"INTERVAL {gap_seconds} SECONDS")).alias("session_end"),
        *aggregates)
