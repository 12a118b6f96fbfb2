"""Multiset operations, NOT IN, JSON columns and the period table function on edge rows."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from costmart.functions.periods import register_period_rows
from costmart.operators import semistructured as J
from costmart.operators import sets as S

SCHEMA = "i int, s string"
A = [(1, "a")] * 5 + [(None, None)] * 3 + [(2, None), (None, "x")] + [(7, "hot")] * 25_000
B = [(1, "a")] * 2 + [(None, None)] * 4 + [(2, None), (3, "b")] + [(7, "hot")] * 23_456


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_multisets_with_nulls_and_a_hot_row(spark):
    a, b = spark.createDataFrame(A, SCHEMA), spark.createDataFrame(B, SCHEMA)
    assert rows(S.intersect_all(a, b)) == Counter(A) & Counter(B) == rows(a.intersectAll(b))
    assert rows(S.except_all(a, b)) == Counter(A) - Counter(B) == rows(a.exceptAll(b))
    assert rows(S.except_all(b, a)) == Counter(B) - Counter(A)
    assert rows(S.except_all(a, b.limit(0))) == Counter(A)
    assert rows(S.intersect_all(a, b.limit(0))) == Counter()
    assert rows(S.intersect_all(a, b.toDF("x", "y"))) == Counter(A) & Counter(B)


def test_multiset_widths_and_chunks(spark):
    a = spark.createDataFrame(A, SCHEMA)
    with pytest.raises(ValueError):
        S.intersect_all(a, a.select("i"))
    one = spark.createDataFrame([(1, "a")], SCHEMA)
    many = S.replicate(one, F.lit(S.CHUNK * 2 + 1).cast("long"), one.columns)
    assert many.count() == S.CHUNK * 2 + 1
    assert "Cartesian" not in many._jdf.queryExecution().toString()


@pytest.mark.parametrize("right", [[], [1, 1], [None], [1, None], [9]])
def test_not_in(spark, right):
    left = [(1, "a"), (2, "b"), (None, "c"), (2, "b")]
    df = spark.createDataFrame(left, SCHEMA)
    keys = spark.createDataFrame([(k,) for k in right], "k int")
    df.createOrReplaceTempView("nl")
    keys.createOrReplaceTempView("nr")
    want = rows(spark.sql("SELECT * FROM nl WHERE i NOT IN (SELECT k FROM nr)"))
    found = S.not_in(df, "i", keys, "k")
    assert rows(found) == want and found.columns == ["i", "s"]
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


JSON = [('{"k": 1}',), ('{"k": "a", "z": null}',), ("{bad",), ("[1]",), (None,), ("{}",), ("",),
        ('{"k": 2, "m": {"x": [1, 2]}}',), ('{"k": 1}',), ('{"k": 1, "k": 2}',)]


def test_json_states_and_paths(spark):
    df = spark.createDataFrame(JSON, "p string")
    states = Counter(r.json_state for r in J.parsed(df, "p").collect())
    assert states == {"object": 5, "bad": 3, "not_object": 1, "missing": 1}
    got = J.extract(df, "p", {"k": ("$.k", "long"), "x": ("$.m.x[1]", "int")})
    assert got.columns == ["p", "k", "x"]
    assert Counter((r.k, r.x) for r in got.collect()) == {(1, None): 2, (2, 2): 1, (None, None): 7}


def test_json_statistics_and_drift(spark):
    df = spark.createDataFrame(JSON, "p string")
    stats = {(r.key, r.kind): tuple(r)[2:] for r in J.key_statistics(df, "p").collect()}
    assert stats[("k", "BIGINT")] == (3, 2, "1", "2") and stats[("k", "STRING")] == (1, 1, "a", "a")
    assert stats[("z", "VOID")] == (1, 0, None, None) and len(stats) == 4
    drift = {(r.key, r.found): r.n_rows
             for r in J.drift(df, "p", {"k": "BIGINT"}, F.lit(1)).collect()}
    assert drift.pop(("m", "OBJECT<x: ARRAY<BIGINT>>")) == 1
    assert drift == {(None, "bad"): 3, (None, "not_object"): 1, (None, "missing"): 1,
                     ("k", "STRING"): 1, ("z", "VOID"): 1, ("k", "absent"): 1}
    assert J.drift(df.limit(0), "p", {}, F.lit(1)).count() == 0
    assert J.key_statistics(df.limit(0), "p").count() == 0
    assert "Python" not in J.drift(df, "p", {}, F.lit(1))._jdf.queryExecution().toString()


def test_period_rows(spark):
    register_period_rows(spark)
    day = dt.date
    spans = [(1, 1, day(2024, 1, 30), day(2024, 3, 1)), (1, 2, day(2023, 12, 31), day(2023, 12, 31)),
             (2, 1, None, day(2024, 1, 1)), (2, 2, day(2024, 2, 2), day(2024, 2, 1)),
             (None, None, day(1969, 12, 31), day(1970, 1, 1))]
    df = spark.createDataFrame(spans, "id long, line int, first_day date, last_day date") \
        .withColumn("b", F.lit(0))
    sql = "SELECT * FROM period_rows(TABLE(SELECT * FROM {t}) PARTITION BY b ORDER BY (id, line))"
    got = sorted((tuple(r) for r in spark.sql(sql, t=df).collect()), key=repr)
    want = [(1, 1, "2024-01", 2, 32), (1, 1, "2024-02", 29, 32), (1, 1, "2024-03", 1, 32),
            (1, 2, "2023-12", 1, 33), (None, None, "1969-12", 1, 2), (None, None, "1970-01", 1, 2)]
    assert got == sorted(want, key=repr)
    assert spark.sql(sql, t=df.limit(0)).count() == 0
    single = spark.sql("SELECT id, sum(days) FROM period_rows(TABLE(SELECT * FROM {t})) GROUP BY id", t=df)
    assert sorted((tuple(r) for r in single.collect()), key=repr) == [(1, 33), (None, 2)]


def test_period_rows_carries_an_id_over_batches(spark):
    import pyarrow as pa

    from costmart.functions.periods import PeriodRows
    day = dt.date
    rows_of = lambda ids, d: pa.record_batch(
        {"id": pa.array(ids, pa.int64()), "line": pa.array(range(len(ids)), pa.int32()),
         "first_day": pa.array([day(2024, 1, 1)] * len(ids), pa.date32()), "last_day": pa.array(d, pa.date32())})
    f, two = PeriodRows(), day(2024, 1, 2)
    got = [t.column("running_days").to_pylist() for b in (
        rows_of([1, 1, 2], [two] * 3), rows_of([2, 2], [two] * 2), rows_of([], []), rows_of([2, 3], [two] * 2))
        for t in f.eval(b)]
    assert got == [[2, 4, 2], [4, 6], [], [8, 2]]


def test_period_rows_mark_the_first_row_of_an_id_in_a_month(spark):
    import pyarrow as pa

    from costmart.functions.periods import OpeningPeriodRows
    rng, day, f = random.Random(3), dt.date(2024, 1, 1), OpeningPeriodRows()
    ids = sorted(rng.choice([*range(12), 5, 5, 5]) for _ in range(90))
    spans = [(i, n, day + dt.timedelta(a), day + dt.timedelta(a + rng.randrange(120)))
             for n, i in enumerate(ids) for a in [rng.randrange(300)]]
    schema = pa.schema({"id": pa.int64(), "line": pa.int32(), "first_day": pa.date32(), "last_day": pa.date32()})
    got, cut = [], 0
    while cut < len(spans):
        part = spans[cut:cut + rng.randrange(8)]
        cut += len(part)
        batch = pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in part], schema)
        got += [r for t in f.eval(batch) for r in t.to_pylist()]
    opening = [(r["id"], r["period"]) for r in got if r["opens"]]
    assert Counter(opening) == Counter({(r["id"], r["period"]): 1 for r in got})
    firsts = {}
    for r in got:
        firsts.setdefault((r["id"], r["period"]), r["line"])
    assert {(r["id"], r["period"]): r["line"] for r in got if r["opens"]} == firsts


def test_period_query_counts_orders_without_a_shuffle_of_ids(spark):
    from costmart.plans.catalog import QUERIES
    plan = QUERIES["period_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [period" in plan and "distinct" not in plan.lower()
    assert "opens" in plan
