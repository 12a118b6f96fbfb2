"""As-of and interval joins, smaller counts, running and rolling measures against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from costmart.operators import ordered as O
from costmart.plans import catalog

T0 = dt.datetime(2025, 1, 1)
SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def sides(seed, n=300, hot=0.4):
    """Rows with ties, null keys and times, repeated rows, and one key that holds many rows."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None])
        out.append((i % (n - 20), key, at(rng.choice([None, *range(60)])), rng.choice([None, i])))
    return out


LEFT = "lid long, k string, lt timestamp_ntz, x long"
RIGHT = "rid long, k string, rt timestamp_ntz, y long"


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("parts", [1, 13])
def test_asof_join(spark, strict, parts):
    left, right = sides(1), sides(2)
    got = O.asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT),
                      ["k"], "lt", "rt", ["rid", "rt", "y"], "rid", strict=strict, parts=parts)
    want = []
    for lid, k, lt, x in left:
        fits = [r for r in right if k is not None and lt is not None and r[1] == k
                and r[2] is not None and (r[2] < lt or (not strict and r[2] == lt))]
        best = max(fits, key=lambda r: (r[2], r[0])) if fits else (None,) * 4
        want.append((lid, k, lt, x, best[0], best[2]))
    assert sorted(map(repr, (tuple(r)[:6] for r in got.collect()))) == sorted(map(repr, want))
    assert got.columns == ["lid", "k", "lt", "x", "last_rid", "last_rt", "last_y"]


def test_asof_empty_sides_and_clashes(spark):
    left, right = spark.createDataFrame(sides(1), LEFT), spark.createDataFrame(sides(2), RIGHT)
    args = (["k"], "lt", "rt", ["rid"], "rid")
    assert O.asof_join(left.limit(0), right, *args).count() == 0
    none = O.asof_join(left, right.limit(0), *args)
    assert none.count() == 300 and none.where("last_rid IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        O.asof_join(left.withColumn("LAST_rid", F.lit(1)), right, *args)
    odd = left.withColumns({"side": F.lit(1), "o0": F.lit(2), "l.r": F.lit(3), "_part": F.lit(4)})
    assert O.asof_join(odd, right, *args).columns == [*odd.columns, "last_rid"]


def test_asof_hot_key_is_split(spark):
    """One key with all rows: no part, and so no window, holds more than a few of them."""
    rows = spark.range(20_000).select(F.col("id").alias("lid"), F.lit("hot").alias("k"),
                                      F.timestamp_seconds(F.col("id") % 5000).alias("lt"))
    dealt = O.split_ordered(rows, ["k"], ["lt", "lid"], 16)
    sizes = [r["count"] for r in dealt.groupBy(O.PART).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 20_000 / 16 * 3
    right = rows.where("lid % 1000 = 7").withColumnsRenamed({"lid": "rid", "lt": "rt"})
    got = O.asof_join(rows, right, ["k"], "lt", "rt", ["rid"], "rid", parts=16)
    text = plan(got)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    times = sorted((i % 5000, i) for i in range(20_000) if i % 1000 == 7)
    want = sum(max((t, i) for t, i in times if t <= x % 5000)[1] for x in range(20_000)
               if x % 5000 >= 7)
    assert got.agg(F.sum("last_rid")).first()[0] == want


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("bin_rows", [10_000, 5])
def test_interval_join(spark, keys, bin_rows):
    left, right = sides(3, 200), sides(4, 200)
    got = O.interval_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT),
                          "lt", "rt", 120, 300, keys, bin_rows=bin_rows)
    want = [(a, b) for a in left for b in right
            if a[2] is not None and b[2] is not None
            and (not keys or (a[1] is not None and a[1] == b[1]))
            and -120 <= (b[2] - a[2]).total_seconds() <= 300]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(a + b) for a, b in want)
    text = plan(got)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    empty = spark.createDataFrame([], RIGHT)
    assert O.interval_join(spark.createDataFrame(left, LEFT), empty, "lt", "rt", 1, 1).count() == 0


@pytest.mark.parametrize("parts", [1, 9])
def test_count_smaller(spark, parts):
    rng = random.Random(5)
    left = [(i, rng.choice([None, *range(30)])) for i in range(200)] * 2
    right = [(rng.choice([None, 7, 7, 7, *range(30)]),) for _ in range(500)]
    got = O.count_smaller(spark.createDataFrame(left, "i long, v long"),
                          spark.createDataFrame(right, "w long"), "v", "w", parts=parts)
    want = [(i, v, None if v is None else sum(w is not None and w < v for w, in right))
            for i, v in left]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    none = O.count_smaller(spark.createDataFrame(left, "i long, v long"),
                           spark.createDataFrame([], "w long"), "v", "w", parts=parts)
    assert {r["n_smaller"] for r in none.where("v IS NOT NULL").collect()} == {0}
    assert "NestedLoop" not in plan(got) and "CartesianProduct" not in plan(got)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("parts", [1, 9])
def test_running_total(spark, keys, parts):
    rng = random.Random(6)
    rows = [(i, "hot" if i % 3 else rng.choice(["a", None, "b"]), rng.choice([None, 1, 5]))
            for i in range(300)]
    got = O.running_total(spark.createDataFrame(rows, "i long, k string, v long"), "v", ["i"],
                          keys, parts=parts)
    want = []
    for i, k, v in rows:
        seen = [w for j, q, w in rows if j <= i and (not keys or q == k) and w is not None]
        want.append((i, k, v, sum(seen) if seen else None))
    assert sorted(map(tuple, got.collect())) == want
    assert got.columns == ["i", "k", "v", "running_total"]


@pytest.mark.parametrize("bucket_days", [1, 8, 500])
def test_rolling_sum(spark, bucket_days):
    rng = random.Random(7)
    dates = [None, *(dt.date(1969, 12, 1) + dt.timedelta(d) for d in range(90))]
    rows = [(rng.choice(["a", "b", None]), rng.choice(dates), rng.choice([None, 1, 2]))
            for _ in range(250)]
    got = O.rolling_sum(spark.createDataFrame(rows, "k string, d date, v long"), "v", "d", 7, ["k"],
                        bucket_days=bucket_days)
    want = []
    for k, d, v in rows:
        near = [w for q, e, w in rows if d and e and q == k and 0 <= (d - e).days < 7
                and w is not None]
        want.append((k, d, v, sum(near) if near else None, len(near) if d else None))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_no_window_without_keys(spark):
    for name in ("smaller_lines", "running_cost", "asof_last_view"):
        text = plan(catalog.QUERIES[name](spark, SF))
        assert "SinglePartition" not in text or "Window" not in text, name


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("parts", [1, 13])
def test_interval_totals(spark, keys, parts):
    """Sums over the pairs of an interval without the pairs; repeated rows count for themselves."""
    left, right = sides(7), sides(8)
    got = O.interval_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT),
                          "lt", "rt", 600, 120, keys, parts=parts,
                          totals={"n": F.col("rid").isNotNull().cast("long"), "y": F.col("y")})
    want = []
    for lid, k, lt, x in left:
        near = [r for r in right if lt is not None and r[2] is not None and (
            not keys or (k is not None and r[1] == k))
            and lt - dt.timedelta(seconds=600) <= r[2] <= lt + dt.timedelta(seconds=120)]
        values = [r[3] for r in near if r[3] is not None]
        if near:
            want.append((lid, k, lt, x, len(near), sum(values) if values else None))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_interval_counts_make_no_pairs(spark):
    """Five thousand rows in one interval on each side would be 25 million pairs."""
    rows = spark.range(5000).select("id", F.lit(T0).cast("timestamp_ntz").alias("t"))
    got = O.interval_join(rows, rows, "t", "t", 60, 60, totals={"n": F.lit(1)})
    assert got.groupBy("n").count().collect() == [(5000, 5000)]
    text = plan(catalog.QUERIES["interval_counts"](spark, SF))
    assert "near_event_id" not in text
