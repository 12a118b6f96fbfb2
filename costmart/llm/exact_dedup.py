"""Exact deduplication by 128-bit content hash with a byte comparison inside groups.

Rows are grouped by the MD5 (128 bits) of the normalised text *and* the text
itself, so rows share a group only if their bytes are equal: the hash decides
where a row goes, the text comparison of the aggregation excludes collisions.
Partial aggregation collapses copies before the shuffle, so a group that holds
a third of all rows reaches each reducer as one row per map task.  The narrow
group table is joined back on the hash; AQE splits a hot hash there.

Defined cases: a null text counts as the empty text, and empty texts are equal
to each other; a null id never stays unless its whole group has null ids
(then ``keep_id`` is null); rows that repeat an id and a text are the same
record and carry the same result; an empty table gives an empty result; other
columns of the input, whatever their names, are ignored by ``duplicates`` and
kept by ``drop_duplicates``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from costmart.llm.common import fresh, keep_table, lower_az, pairs


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = pc.fill_null(lower_az(b.column("text")), "")
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), text], ["doc_id", "norm"])


def _hashed(docs: DataFrame, id_col: str, text_col: str, content_hash) -> DataFrame:
    return (docs.select(*pairs(id_col, text_col))
            .mapInArrow(_normalised, "doc_id long, norm string")
            .withColumn("h", content_hash(F.col("norm"))))


def _groups(rows: DataFrame, stays) -> tuple[DataFrame, DataFrame]:
    """(hash -> result where the hash has one text, (hash, text) -> result elsewhere)."""
    groups = rows.groupBy("h", "norm").agg(stays("doc_id").alias("keep_id"),
                                           F.count(F.lit(1)).alias("group_size"))
    # One row per hash; the text travels on only if another text has the same hash.
    variants = groups.groupBy("h").agg(
        F.count(F.lit(1)).alias("variants"), F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size"))
    return variants, groups


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               keep: str = "smallest",
               content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    ``keep`` names the id that stays: ``smallest`` or ``largest``.
    ``content_hash`` is the grouping hash (a parameter so that tests can force
    collisions).
    """
    stays = {"smallest": F.min, "largest": F.max}[keep]
    rows = _hashed(docs, id_col, text_col, content_hash)
    variants, groups = _groups(rows, stays)
    variants = keep_table(variants, "exact-groups")
    narrow = rows.withColumn("text_sha256", F.sha2("norm", 256))
    single = variants.where("variants = 1").select("h", "keep_id", "group_size")
    out = narrow.select("doc_id", "h", "text_sha256").join(single, "h")
    collided = variants.where("variants > 1").select("h")
    if not collided.isEmpty():
        apart = groups.join(collided, "h", "left_semi")
        out = out.unionByName(
            narrow.join(apart, ["h", "norm"]).select("doc_id", "h", "text_sha256",
                                                     "keep_id", "group_size"))
    return out.select("doc_id", "keep_id", "group_size",
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    keep: str = "smallest") -> DataFrame:
    """The rows of ``docs``, all columns, one per group of equal texts.

    Among rows that repeat the kept id and the text, one stays.
    """
    columns = docs.columns
    sha_name, n_name = fresh("text_sha256", columns), fresh("row_number", columns)
    decided = keep_table(
        duplicates(docs, id_col, text_col, keep).where("kept")
        .groupBy(F.col("doc_id").alias("keep_id"), "text_sha256")
        .agg(F.count(F.lit(1)).alias("rows")), "exact-kept")
    at = columns.index(text_col)

    def add_sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.fill_null(lower_az(b.column(at).cast(pa.string())), "").cast(pa.binary())
            sha = pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in text], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, sha], [*b.schema.names, sha_name])

    hashed = docs.mapInArrow(add_sha, StructType([*docs.schema.fields])
                             .add(sha_name, StringType()))
    same = (hashed[sha_name] == decided["text_sha256"]) & \
        hashed[f"`{id_col}`"].cast("long").eqNullSafe(decided["keep_id"])
    kept = hashed.join(decided, same).select(
        *[hashed[f"`{c}`"] for c in columns], hashed[sha_name])
    if not decided.where("rows > 1").isEmpty():  # rows that repeat an id and a text
        one = Window.partitionBy(sha_name, F.col(f"`{id_col}`")).orderBy(F.lit(0))
        kept = kept.withColumn(n_name, F.row_number().over(one)).where(F.col(n_name) == 1)
    return kept.select(*[F.col(f"`{c}`") for c in columns])
