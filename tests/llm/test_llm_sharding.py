import zlib
from collections import defaultdict

from helpers import EDGES, edges, frame
from costmart.llm import sharding

SF = "/root/testdata/sf0.001"


def check(rows, docs, shards):
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted(
        (str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(shards))
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_law_rows_with_many_buckets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for size in (1 << 12, 1 << 24):
        check(sharding.shard_digest(docs, 24, bucket_bytes=size).collect(), given, 24)


def test_seed_decides_and_partitions_do_not(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    place = lambda df, seed: {r["doc_id"]: (r["shard"], r["slot"]) for r in
                              sharding.shard_digest(df, 8, seed, bucket_bytes=1 << 14).collect()}
    first = place(docs, 1)
    assert place(docs.repartition(5), 1) == first
    assert place(docs, 2) != first
    neighbours = sum(first.get(i) == (first[i - 1][0], first[i - 1][1] + 1)
                     for i in first if i - 1 in first)
    assert neighbours < 10                            # the order is not the ids' order


def test_written_texts_edges_and_empty(spark):
    docs = edges(spark)
    path = sharding.write_shards(docs, 3)
    written = sharding.read_shards(spark, path).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in written) == \
        sorted((str(r[0]), str(r[1])) for r in EDGES)
    check(sharding.shard_digest(docs, 24).collect(), [r[:2] for r in EDGES], 24)
    assert sharding.shard_digest(frame(spark, []), 24).collect() == []


def test_repeated_record_is_dealt_over_the_buckets(spark):
    from pyspark.sql import functions as F
    hot = [(7, "x" * 92), (None, "y" * 992), (8, None)]
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in hot]) \
        .withColumn("n", F.explode(F.expr("sequence(1, case when doc_id = 7 then 100000 "
                                          "when doc_id = 8 then 3 else 2000 end)"))).drop("n") \
        .unionByName(frame(spark, [(i, f"text {i}", "en", "s", 1) for i in range(100, 400)]))
    size = 1 << 19
    rows = sharding.write_shards(docs, 24, bucket_bytes=size)
    check(sharding.shard_digest(docs, 24, bucket_bytes=size).collect(),
          [(r["doc_id"], r["text"]) for r in docs.collect()], 24)
    # No written file holds more than a few buckets' share of the 100,000 copies.
    files = (sharding.read_shards(spark, rows).groupBy(F.input_file_name().alias("f"))
             .agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect())
    assert sum(r["n"] for r in files) == 102303
    per_bucket = dict((r["bucket"], r["bytes"]) for r in sharding._bucketed(
        docs.select("doc_id", "text", (F.octet_length(F.coalesce("text", F.lit(""))) + 8)
                    .cast("long").alias("size"),
                    F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc")),
        24, size, 17)[0].groupBy("bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"))
        .collect())
    assert len(per_bucket) >= 20 and max(per_bucket.values()) < 5 * size
