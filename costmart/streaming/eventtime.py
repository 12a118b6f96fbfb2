"""Event-time streams: late rows set apart, windows, sessions and joins of two streams.

A job runs in two steps, each with its own checkpoint. ``run_gate`` splits what
has arrived into accepted and late rows: a row is late if its time is not after
the greatest time of all earlier batches less the allowed delay. That time is
written beside the rows of each batch under the batch's number, so a batch that
runs again after a failure decides alike and replaces what it had written. The
second step (``run_windows``, ``run_sessions``, ``run_join``) is one of Spark's
stateful operators over the accepted rows, with a watermark of the same delay.
It starts when the gate has ended, so its watermark is never ahead of the
gate's: it drops no row, and an accepted row never belongs to a window or
session that was already put out.

State is bounded by the delay: what the watermark has passed is put out once
and forgotten; what it has not passed stays in the checkpoint for the next run.
Rows without a time go with the late rows (no window can hold them).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

#: Microseconds: the time form in which bounds are kept.
BOUND = "bound long"


def _finish(query: StreamingQuery) -> StreamingQuery:
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return query


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(f"`{time}`").cast("timestamp"))


def run_gate(spark: SparkSession, source: str, schema: T.StructType, base: str, time: str,
             delay_seconds: int) -> StreamingQuery:
    """Split the new rows of the Parquet folder ``source`` into ``base``/accepted and /late.

    Works off what has arrived as one batch, then stops; a later run goes on
    from the checkpoint. The first batch has no bound, so none of its rows is
    late for its time.
    """
    delay = delay_seconds * 1_000_000

    def split(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        # What the batch before left, not what an earlier attempt at this one wrote.
        bound = (session.read.schema(BOUND).parquet(f"{base}/bounds/batch={batch - 1}").first()[0]
                 if batch else None)
        in_time = F.col("_at").isNotNull()
        if bound is not None:
            in_time &= F.col("_at") > bound - delay
        timed = rows.withColumn("_at", _micros(time))
        timed.where(in_time).drop("_at").write.mode("overwrite").parquet(
            f"{base}/accepted/batch={batch}")
        timed.where(~in_time).drop("_at").write.mode("overwrite").parquet(
            f"{base}/late/batch={batch}")
        known = F.lit(bound).cast("long")
        (timed.agg(F.greatest(F.max("_at"), known).alias("bound"))
         .write.mode("overwrite").parquet(f"{base}/bounds/batch={batch}"))

    stream = spark.readStream.schema(schema).parquet(source)
    return _finish(stream.writeStream.option("checkpointLocation", f"{base}/_gate")
                   .trigger(availableNow=True).foreachBatch(split).start())


def late_rows(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    """The rows the gate has set apart, with the batch they came in."""
    return (spark.read.schema(T.StructType([*schema, T.StructField("batch", T.LongType())]))
            .option("basePath", f"{base}/late").parquet(f"{base}/late/batch=*"))


def accepted_stream(spark: SparkSession, base: str, schema: T.StructType, time: str,
                    delay_seconds: int) -> DataFrame:
    """The accepted rows as a stream with its watermark."""
    return (spark.readStream.schema(schema).parquet(f"{base}/accepted/batch=*")
            .withColumn(time, F.col(f"`{time}`").cast("timestamp"))
            .withWatermark(time, f"{delay_seconds} seconds"))


def run_append(result: DataFrame, base: str, name: str) -> DataFrame:
    """Append what is final to the table ``base``/``name``; the table, read back whole.

    The file sink's log names the files of finished batches, so files of a
    failed attempt are not read.
    """
    spark, path = result.sparkSession, f"{base}/{name}"
    _finish(result.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", f"{base}/_{name}").trigger(availableNow=True).start())
    return spark.read.schema(result.schema).parquet(path)


def run_windows(spark: SparkSession, base: str, schema: T.StructType, time: str,
                delay_seconds: int, keys: Sequence[str], aggregates: Sequence[Column],
                size: str, slide: str | None = None, name: str = "windows") -> DataFrame:
    """Closed tumbling (or with ``slide`` sliding) windows per key: keys, window start and end,
    aggregates. Null keys are a key like any other."""
    rows = accepted_stream(spark, base, schema, time, delay_seconds)
    frame = F.window(time, size, slide) if slide else F.window(time, size)
    found = (rows.groupBy(frame, *keys).agg(*aggregates)
             .withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")})
             .drop("window"))
    return run_append(found, base, name)


def run_sessions(spark: SparkSession, base: str, schema: T.StructType, time: str,
                 delay_seconds: int, keys: Sequence[str], aggregates: Sequence[Column],
                 gap_seconds: int, name: str = "sessions") -> DataFrame:
    """Closed sessions per key: rows of a key less than the gap apart, merged in the state.

    Columns: keys, session_start, session_end (last time plus gap), aggregates.
    Spark merges sessions that touch; a microsecond less keeps rows that are the
    whole gap apart in sessions of their own, as in ``operators.sessions``.
    """
    tick = F.expr("INTERVAL 0.000001 SECONDS")
    gap = f"{gap_seconds * 1_000_000 - 1} microseconds"
    rows = accepted_stream(spark, base, schema, time, delay_seconds)
    found = (rows.groupBy(F.session_window(time, gap), *keys).agg(*aggregates)
             .withColumns({"session_start": F.col("session_window.start"),
                           "session_end": F.col("session_window.end") + tick})
             .drop("session_window"))
    return run_append(found, base, name)


def run_join(spark: SparkSession, base: str, schema: T.StructType, time: str, delay_seconds: int,
             keys: Sequence[str], left: Column, right: Column, before_seconds: int,
             after_seconds: int, prefix: str = "near_", name: str = "joined") -> DataFrame:
    """Left outer interval join of two parts of the stream.

    Rows that meet ``left`` are paired with rows that meet ``right``, have equal
    keys and a time from ``before_seconds`` before to ``after_seconds`` after.
    A left row without a partner is put out with NULLs as soon as the watermark
    shows that none can come; it then leaves the state, as right rows do.
    """
    rows = accepted_stream(spark, base, schema, time, delay_seconds)
    lefts = rows.where(left)
    rights = accepted_stream(spark, base, schema, time, delay_seconds).where(right)
    rights = rights.select(*(F.col(f"`{c}`").alias(f"{prefix}{c}") for c in rights.columns))
    on = ((F.col(f"{prefix}{time}") >= F.col(time) - F.expr(f"INTERVAL {before_seconds} SECONDS"))
          & (F.col(f"{prefix}{time}") <= F.col(time) + F.expr(f"INTERVAL {after_seconds} SECONDS")))
    for k in keys:
        on &= F.col(f"`{k}`") == F.col(f"`{prefix}{k}`")
    return run_append(lefts.join(rights, on, "leftOuter"), base, name)
