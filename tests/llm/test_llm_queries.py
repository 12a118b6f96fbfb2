"""The registered queries on the small table: columns, SQL, and the pipeline's stages."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from helpers import brute_components
from costmart.llm import fertility, queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,"
           " n_repeat_words bigint, base_failed boolean, kept boolean",
    "op2": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op3": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op4": "page_id bigint, url string, text string, n_chars bigint",
    "op5": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint,"
           " grown_shard int",
    "op6": "page_id bigint, host string, path string, rule string, verdict string",
    "op7": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint,"
            " sequence_id bigint, offset bigint",
    "op11": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint,"
            " score bigint",
    "op12": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint,"
            " n_best bigint, count_sum bigint, groups_sha256 string",
    "op13": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


def test_one_query_per_operator():
    assert sorted(q.split("_")[0] for q in queries.QUERIES) == sorted(COLUMNS)
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, name):
    df = entry.queries()[name](spark, SF)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for column in COLUMNS[name.split("_")[0]].split(", "):
        key, kind = column.split()
        assert types[key] == kind, key
    if name.startswith("op11_"):         # a report, compared with SQL below
        assert df.count()
        return
    table = "pages" if name.startswith(("op4_", "op6_")) else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert df.count() == n or name.startswith("op10_") and df.where("piece = 0").count() == n


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    found = con.execute(queries.ORACLE[name])
    names = [d[0] for d in found.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == \
        sorted(found.fetchall(), key=repr)


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    rows = {}
    for i, (stage, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        rows[stage] = docs.collect()
        assert i == 4 or docs.columns == names
    ids = lambda stage: [r["doc_id"] for r in rows[stage]]
    assert set(ids("quality rules")) <= set(ids("toxicity"))
    good = {r["doc_id"] for r in fertility.measure(
        spark.read.parquet(f"{tmp_path}/0")).where("kept").collect()}
    assert set(ids("quality rules")) == good
    seen = {}
    for r in sorted(rows["quality rules"], key=lambda r: r["doc_id"]):
        seen.setdefault(r["text"].translate(str.maketrans(
            "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), r["doc_id"])
    assert sorted(ids("exact dedup")) == sorted(seen.values())
    comps = brute_components([(r["doc_id"], r["text"]) for r in rows["exact dedup"]], 5, 80)
    assert sorted(ids("near dedup")) == sorted(i for i, (_, c) in comps.items() if c == i)
    assert set(ids("packing")) == set(ids("near dedup"))


def test_run_gives_the_stages_rows(spark):
    first, again = (corpus_pipeline.run(spark, SF) for _ in range(2))
    some = "doc_id piece start length ids_crc32".split()
    assert sorted(map(tuple, first.select(*some).collect())) == \
        sorted(map(tuple, again.select(*some).collect()))
    assert os.path.isdir(SF)
