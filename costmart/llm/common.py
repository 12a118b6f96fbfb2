"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costmart.session import shared_dir

#: A word: a run of characters other than blank, tab, LF, VT, FF, CR.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage with a copy that every executor can read, so a lost
    executor costs a re-read, not a recomputation.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pairs(ids: str, text: str) -> list[Column]:
    """The id and the text column under internal names (any other column is left out)."""
    return [F.col(f"`{ids}`").cast("long").alias("doc_id"),
            F.col(f"`{text}`").cast("string").alias("text")]


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def held_out(ids: Column) -> Column:
    """True for rows whose crc32(id as text) mod 4 is 2 (a null id is never held out)."""
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def first_by_hash(rows: DataFrame, ids: Column, wanted: int, among: Column) -> DataFrame:
    """The rows of the lowest id hashes (column ``hash``): about twice ``wanted`` of ``among``.

    Taken before the ``wanted`` first ones are sorted out, it bounds what any
    task or the driver gets to see, whatever the number of partitions.
    """
    hashed = rows.withColumn("hash", F.pmod(F.xxhash64(ids), F.lit(1 << 30)))
    share = 2.0 * wanted / F.greatest(among, F.lit(1)) + 100.0 / F.greatest(among, F.lit(1))
    return hashed.where(F.col("hash") < F.least(F.lit(1.0), share) * (1 << 30))


def lower_az(text: pa.Array) -> pa.Array:
    """A-Z to a-z and nothing else; null stays null."""
    return pc.ascii_lower(text)


def pieces(batches: Iterable[pa.RecordBatch], column: str | int,
           max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``max_bytes`` of ``column``.

    Keeps a Python worker's memory flat whatever the length of the texts; a
    single longer text is a batch of its own.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
