"""Incremental ingest of feed drops with Structured Streaming.

The batch load (read both feeds, union, clean, keep as month-partitioned
Parquet) as a stream: new CSV files landing in the feed folders are read with
the same text schemas, unioned by name, cleaned with the same expressions and
appended to the month-partitioned table. The checkpoint folder records which
files were processed, so a restarted or failed job neither skips nor repeats a
file. ``available_now`` processes what is there and stops (a scheduled job);
otherwise the query keeps running.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from costmart.operators.clean import clean
from costmart.schema import DEFAULT_COLUMNS, Columns
from costmart.session import free_shuffles
from costmart.sources.feeds import CORRUPT, FeedSpec, check_width, landing_schema, unify
from costmart.sources.sinks import write_table


#: Bytes of a feed's files that a batch takes, about (it takes one file at least).
BATCH_BYTES = 256 << 20


def read_feed_stream(spark: SparkSession, spec: FeedSpec, header_columns: Sequence[str] | None = None,
                     max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """One feed folder as a stream of canonical-named text rows, in batches of at most
    ``max_files`` files or, without that, of about ``max_bytes`` (None: ``BATCH_BYTES``).

    A stream needs its schema up front: positional names for a headerless feed,
    the source header names (``header_columns``) for a feed with a header.
    """
    names = list(spec.columns) if spec.columns is not None else list(header_columns or [])
    if not names:
        raise ValueError("a streaming feed needs its column names")
    reader = (spark.readStream.schema(landing_schema(names)).option("sep", spec.sep)
              .option("header", spec.header).option("encoding", spec.encoding)
              .option("escape", '"').option("multiLine", spec.multi_line)
              .option("enforceSchema", not spec.header)
              .option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    else:
        reader = reader.option("maxBytesPerTrigger", max_bytes or BATCH_BYTES)
    df = check_width(reader.csv(spec.path), spec, len(names))
    if spec.rename:
        df = df.withColumnsRenamed(spec.rename)
    if spec.copy_payer and "jenis_jaminan" in df.columns:
        df = df.withColumn("sumber_pembayaran", F.col("jenis_jaminan"))
    return df


def start_ingest(spark: SparkSession, specs: Sequence[FeedSpec], table_path: str,
                 checkpoint: str, header_columns: dict[str, Sequence[str]] | None = None,
                 available_now: bool = True, cols: Columns = DEFAULT_COLUMNS,
                 max_files: int | None = None, max_bytes: int | None = None) -> StreamingQuery:
    """Start the stream: feeds -> clean -> month-partitioned table.

    Each micro-batch is written by ``sinks.write_table`` (range-partitioned, so
    few files per month) to its own ``batch=N`` folder in overwrite mode; a
    batch that runs again after a failure replaces what it had written.
    ``max_files`` or ``max_bytes`` bound what a batch takes of a feed, so the rows
    kept and shuffled at a time do not grow with what has landed.
    """
    header_columns = header_columns or {}
    streams = [read_feed_stream(spark, s, header_columns.get(s.path), max_files, max_bytes)
               for s in specs]
    cleaned = clean(unify(streams), cols)

    def write_batch(rows: DataFrame, batch: int) -> None:
        # Kept, as the bounds of the ranges and the ranges both read the rows.
        rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            write_table(rows, f"{table_path}/batch={batch}", cols)
        finally:
            rows.unpersist()
            free_shuffles(spark)

    writer = cleaned.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write_batch)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="1 minute")
    return writer.start()
