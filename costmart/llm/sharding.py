"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets by a seeded hash of the
record, so many that a bucket fits in a task's memory.  A record repeated so
often that its copies would fill a quarter of a bucket is counted and dealt in
chunks of such a quarter, each with a hash of its own.  Pass 2 reads a bucket,
puts it in a fixed order, Fisher-Yates-shuffles it with a generator seeded by
(seed, bucket) and writes it.  Bucket counts give each bucket its place in the
global order; the order is cut into ``shards`` runs whose row counts are at
most one apart (law ``rows``), so a bucket touches one or two shards and the
number of files follows the number of buckets.

The result depends on the rows, the seed and the sizes only, not on Spark's
partitions, so a task that runs again writes the same rows.

Defined cases: a null text has size 8 (no bytes) and CRC 0 and stays null in
the files; a null id is a record like any other; rows that repeat all values
are all written, each with a slot of its own; with fewer rows than shards some
shards are empty; an empty table writes nothing and gives an empty result;
other columns are neither read nor written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costmart.llm.common import keep_table, pairs
from costmart.session import shared_dir

#: Text bytes of a bucket: what one task of pass 2 holds in memory.
BUCKET_BYTES = 16 << 20
#: Most buckets whose places are sent to every task (24 bytes each).
PLACES_TO_ALL = 1 << 20


def _places(counts: DataFrame) -> DataFrame:
    """bucket -> rows before it: a prefix sum in two levels, no single task over all buckets."""
    runs = counts.withColumn("run", F.expr("bucket div 1024"))
    before = (runs.groupBy("run").agg(F.sum("rows").alias("rows"))
              .select("run", (F.sum("rows").over(Window.orderBy("run")) - F.col("rows"))
                      .alias("run_start")))
    inside = F.sum("rows").over(Window.partitionBy("run").orderBy("bucket")) - F.col("rows")
    return (runs.withColumn("inside", inside).join(before, "run")
            .select("bucket", (F.col("run_start") + F.col("inside")).alias("start")))


def _shuffled(seed: int, shards: int, total: int):
    """Pass 2 over one bucket: fixed order, Fisher-Yates, shard and slot of each row."""
    # Shard s holds the places from first[s] to first[s + 1].
    first = (np.arange(shards + 1, dtype=object) * total + shards - 1) // shards
    first = np.array(first, dtype=np.int64)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        copies = rows.column("copies").to_numpy()
        if (copies > 1).any():
            rows = rows.take(pa.array(np.repeat(np.arange(len(copies)), copies)))
        order = pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("crc", "ascending"),
                                                 ("size", "ascending")])
        bucket, start = rows.column("bucket")[0].as_py(), rows.column("start")[0].as_py()
        drawn = np.random.Generator(np.random.PCG64([seed, bucket])).permutation(len(order))
        rows = rows.take(order.take(pa.array(drawn)))
        place = start + np.arange(rows.num_rows, dtype=np.int64)
        shard = np.searchsorted(first, place, side="right") - 1
        return pa.table({
            "doc_id": rows.column("doc_id"), "text": rows.column("text"),
            "size": rows.column("size"),
            "slot": pa.array(place - first[shard]), "shard": pa.array(shard.astype(np.int32))})
    return run


def _bucketed(rows: DataFrame, buckets: int, bucket_bytes: int,
              seed: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (doc_id, text, size, crc) with their bucket and the ``copies`` each stands for;
    bucket and rows of every bucket."""
    key = [F.lit(seed), F.col("doc_id"), F.col("crc")]
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets))) \
        .withColumn("copies", F.lit(1).cast("long"))
    sizes = keep_table(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"),
                                                   F.sum("size").alias("bytes")), "bucket-sizes")
    full = sizes.where(F.col("bytes") > 2 * bucket_bytes).select("bucket")
    if buckets == 1 or full.isEmpty():
        return dealt, sizes.select("bucket", "rows")
    # Copies of one record that a chunk holds.
    chunk = F.greatest(F.lit(1), F.expr(f"{max(1, bucket_bytes // 4)} div size"))
    often = keep_table(
        dealt.join(full, "bucket", "left_semi").groupBy("doc_id", "crc", "size")
        .agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("n") > chunk)),
        "repeated-records").select("doc_id", "crc", "size").alias("o")
    # Their copies fill a quarter of a bucket each: at most four a bucket.
    often = F.broadcast(often) if 4 * buckets <= PLACES_TO_ALL else often
    same = F.expr("d.doc_id <=> o.doc_id AND d.crc = o.crc AND d.size = o.size")
    once = dealt.alias("d").join(often, same, "left_anti")
    chunks = (dealt.alias("d").join(often, same, "left_semi")
              .groupBy("doc_id", "text", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("per", chunk)
              .withColumn("chunk", F.explode(F.expr("sequence(0L, (n - 1) div per)")))
              .withColumn("bucket", F.pmod(F.xxhash64(*key, "chunk"), F.lit(buckets)))
              .withColumn("copies", F.expr("least(per, n - chunk * per)")))
    dealt = once.unionByName(chunks.select(*dealt.columns))
    return dealt, dealt.groupBy("bucket").agg(F.sum("copies").alias("rows"))


def write_shards(docs: DataFrame, shards: int, seed: int = 17, id_col: str = "doc_id",
                 text_col: str = "text", bucket_bytes: int = BUCKET_BYTES,
                 path: str | None = None) -> str:
    """Write the shuffled records as Parquet under ``path``/shard=N and return the path.

    Columns of the files: doc_id, text, size, slot (place within the shard).
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark, "shards")
    rows = docs.select(*pairs(id_col, text_col))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 8
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).first()
    buckets = max(1, -(-(total["bytes"] or 0) // bucket_bytes))
    rows = rows.withColumn("size", size).withColumn(
        "crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    rows, counts = _bucketed(rows, buckets, bucket_bytes, seed)
    places = keep_table(_places(counts), "bucket-places")
    rows = rows.join(F.broadcast(places) if buckets <= PLACES_TO_ALL else places, "bucket")
    (rows.groupBy("bucket")
     .applyInArrow(_shuffled(seed, shards, total["rows"]),
                   "doc_id long, text string, size long, slot long, shard int")
     .write.partitionBy("shard").parquet(path))
    return path


def read_shards(spark, path: str) -> DataFrame:
    """The written records with their shard."""
    return spark.read.schema("doc_id long, text string, size long, slot long, shard int") \
        .parquet(path)


def shard_digest(docs: DataFrame, shards: int, seed: int = 17, **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard from the written files."""
    spark = docs.sparkSession
    written = read_shards(spark, write_shards(docs, shards, seed, **options))
    return written.select(
        "doc_id", "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
