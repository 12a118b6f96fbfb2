import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from helpers import EDGES, LOWER, SCHEMA, edges, frame
from costmart.llm import exact_dedup


def brute(rows, pick):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in rows:
        norm = (t or "").translate(LOWER)
        ids = [x for x in groups[norm] if x is not None]
        keep = pick(ids) if ids else None
        out.append((i, keep, len(groups[norm]), i == keep,
                    hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edges_against_brute_force(spark):
    for keep, pick in (("smallest", min), ("largest", max)):
        got = exact_dedup.duplicates(edges(spark), keep=keep)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute([r[:2] for r in EDGES], pick)


def test_collisions_are_told_apart(spark):
    rows = [(i, f"text {i % 7}", None, None, None) for i in range(60)]
    weak = lambda c: F.substring(F.md5(c), 1, 1)
    one = lambda c: F.lit("x")
    for hashing in (weak, one):
        got = exact_dedup.duplicates(frame(spark, rows), content_hash=hashing)
        assert sorted(map(tuple, got.collect()), key=repr) == brute([r[:2] for r in rows], min)


def test_hot_group_and_empty_table(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}", None, None, None) for i in range(900)]
    got = exact_dedup.duplicates(frame(spark, rows).repartition(16))
    assert sorted(map(tuple, got.collect()), key=repr) == brute([r[:2] for r in rows], min)
    assert exact_dedup.duplicates(frame(spark, [])).collect() == []
    assert exact_dedup.drop_duplicates(frame(spark, [])).collect() == []


def test_drop_keeps_one_row_and_all_columns(spark):
    docs = edges(spark)
    got = exact_dedup.drop_duplicates(docs)
    assert got.schema == docs.schema
    assert sorted(str(r["doc_id"]) for r in got.collect()) == \
        sorted(["1", "3", "4", "5", "7", "8", "9", "None"])
    assert frame(spark, EDGES, SCHEMA).count() == 11
