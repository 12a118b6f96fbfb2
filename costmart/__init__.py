"""costmart — billing-transaction analytics as Spark DataFrame operators.

Layout
------
``sources``    CSV feeds in, the typed ``billing`` view over the star-schema
               tables, Parquet / CSV sinks.
``functions``  Column -> Column helpers: text parsing, calendar parts, labels.
``operators``  DataFrame -> DataFrame operators: cleaning, codes, filters,
               bounded per-group aggregates, marts, prediction.
``plans``      Named queries composed from operators, plus a dashboard plan
               that persists the filtered frame once and serves all marts.
``streaming``  Incremental ingest of feed drops with Structured Streaming.

Every operator is lazy and returns a DataFrame; nothing collects a group or a
table to the driver.
"""

from costmart.schema import Columns, DEFAULT_COLUMNS

__all__ = ["Columns", "DEFAULT_COLUMNS"]
