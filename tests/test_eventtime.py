"""Sessions against brute force; event-time streams: late rows, restarts, bounded state."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costmart.operators import sessions as S
from costmart.session import shared_dir
from costmart.streaming import eventtime as E

T0 = dt.datetime(2025, 1, 1)
SCHEMA = T.StructType().add("id", "long").add("k", "string").add("ts", "timestamp_ntz").add("v", "long")


def rows(seed, n, span=2000, hot=0.4):
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < hot else rng.choice(["a", "b", None]),
             rng.choice([None, *[T0 + dt.timedelta(minutes=rng.randrange(span))] * 9]), i)
            for i in range(n)]


def brute_sessions(data, gap):
    out = []
    for key in {r[1] for r in data}:
        last, number = None, 0
        for r in sorted((r for r in data if r[1] == key and r[2]), key=lambda r: (r[2], r[0])):
            if last is None or (r[2] - last).total_seconds() >= gap:
                number += 1
            out.append((r[0], number))
            last = r[2]
    return sorted(out + [(r[0], None) for r in data if r[2] is None])


@pytest.mark.parametrize("parts", [1, 13])
@pytest.mark.parametrize("gap", [600, 3600])
def test_sessions_with_hot_key(spark, parts, gap):
    data = rows(1, 400)
    df = spark.createDataFrame(data, SCHEMA)
    got = S.number_sessions(df, ["k"], "ts", "id", gap, parts=parts)
    assert got.columns == [*df.columns, "session"]
    assert sorted((r.id, r.session) for r in got.collect()) == brute_sessions(data, gap)


def test_sessions_gap_border_and_empty(spark):
    at = [T0, T0 + dt.timedelta(seconds=59), T0 + dt.timedelta(seconds=119)]
    df = spark.createDataFrame([(i, "x", t, 0) for i, t in enumerate(at)], SCHEMA)
    found = S.sessions(df, ["k"], "ts", "id", 60, [F.count("id").alias("n")]).collect()
    assert sorted((r.session, r.n) for r in found) == [(1, 2), (2, 1)]
    assert found[0].session_end - found[0].session_start >= dt.timedelta(seconds=60)
    assert S.sessions(df.limit(0), ["k"], "ts", "id", 60, [F.count("id")]).count() == 0


def test_sessions_window_is_keyed_by_part(spark):
    df = S.number_sessions(spark.createDataFrame(rows(2, 50), SCHEMA), ["k"], "ts", "id", 60)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" in text and "_part" in text and "Cartesian" not in text


class Drops:
    """Arrivals written drop by drop, the gate run after each."""

    def __init__(self, spark, delay=600):
        self.spark, self.delay, self.n = spark, delay, 0
        self.base = shared_dir(spark, "test-stream")

    def arrive(self, data):
        (self.spark.createDataFrame(data, SCHEMA).repartition(3)
         .write.parquet(f"{self.base}/in/drop={self.n}"))
        self.n += 1
        self.gate()

    def gate(self):
        return E.run_gate(self.spark, f"{self.base}/in/drop=*", SCHEMA, self.base, "ts", self.delay)

    def accepted(self):
        return sorted(r.id for r in self.spark.read.parquet(f"{self.base}/accepted/batch=*").collect())

    def late(self):
        return sorted((r.id, r.batch) for r in E.late_rows(self.spark, self.base, SCHEMA).collect())

    def windows(self):
        return E.run_windows(self.spark, self.base, SCHEMA, "ts", self.delay, ["k"],
                             [F.sum("v").alias("v"), F.count("id").alias("n")], "10 minutes")


def at(minute, i, key="x"):
    return (i, key, T0 + dt.timedelta(minutes=minute), 1)


def test_gate_splits_late_rows_and_nulls(spark):
    d = Drops(spark)
    d.arrive([at(100, 1), at(0, 2), (3, "x", None, 1)])      # no bound yet: 0 is in time
    d.arrive([at(91, 4), at(90, 5), at(200, 6), at(92, 4)])   # bound 90, repeated id kept
    assert d.accepted() == [1, 2, 4, 4, 6] and d.late() == [(3, 0), (5, 1)]
    d.gate()                                                   # nothing new: nothing repeated
    assert d.accepted() == [1, 2, 4, 4, 6]


def test_windows_after_restart_neither_repeat_nor_skip(spark):
    d = Drops(spark)
    d.arrive([at(m, m) for m in range(0, 60)])
    first = d.windows()
    closed = {(r.k, r.window_start): (r.v, r.n) for r in first.collect()}
    assert closed == {("x", T0 + dt.timedelta(minutes=10 * i)): (10, 10) for i in range(4)}
    assert d.windows().count() == 4                            # run again without new rows
    d.arrive([at(m, 100 + m) for m in range(48, 130)])         # up to 49, the bound, late
    found = d.windows()
    got = {r.window_start: r.n for r in found.collect()}
    late = {i - 100 for i, _ in d.late()}
    ids = [m for m in range(60)] + [m for m in range(48, 130) if m not in late]
    want = {T0 + dt.timedelta(minutes=10 * i): sum(10 * i <= m < 10 * i + 10 for m in ids)
            for i in range(11)}
    assert late == {48, 49} and got == want and found.count() == len(got)


def test_failed_gate_batch_is_replaced(spark, monkeypatch):
    d = Drops(spark)
    d.arrive([at(5, 1)])
    writer = type(spark.range(1).write)
    real = writer.parquet

    def fail(self, path, *args, **kw):
        if "/bounds/" in path:
            raise RuntimeError("lost")
        return real(self, path, *args, **kw)

    monkeypatch.setattr(writer, "parquet", fail)
    with pytest.raises(Exception):
        d.arrive([at(7, 2), at(500, 3)])
    monkeypatch.undo()
    d.gate()
    d.arrive([at(100, 4), at(495, 5)])
    assert d.accepted() == [1, 2, 3, 5] and d.late() == [(4, 2)]




def test_join_puts_out_unmatched_once_and_forgets(spark):
    d = Drops(spark)
    join = lambda: E.run_join(spark, d.base, SCHEMA, "ts", 600, ["k"],
                              F.col("v") == 1, F.col("v") == 2, 1800, 0)
    view = lambda m, i: (i, "x", T0 + dt.timedelta(minutes=m), 2)       # noqa: E731
    seen, kept = [], []
    for step in range(4):
        start = step * 600
        d.arrive([at(start + 40, step * 10), view(start + 30, step * 10 + 1),
                  at(start + 300, step * 10 + 2), view(start + 305, step * 10 + 3),
                  (step * 10 + 4, None, T0 + dt.timedelta(minutes=start + 300), 1)])
        got = join().collect()
        seen.append(len(got))
        state = spark.read.format("statestore").option("joinSide", "left").load(f"{d.base}/_joined")
        kept.append(state.count())
    pairs = [(r.id, r.near_id) for r in got]
    assert len(pairs) == len(set(pairs)) and seen == sorted(seen)
    assert all((s * 10, s * 10 + 1) in pairs for s in range(4))
    assert all((s * 10 + 2, None) in pairs and (s * 10 + 4, None) in pairs for s in range(3))
    assert max(kept) <= 4                                      # earlier steps have left the state


def test_stream_sessions_equal_batch_sessions(spark):
    # Minutes at random: many rows are exactly the gap apart.
    data = [r for r in rows(5, 300) if r[2]]
    d = Drops(spark, delay=0)
    d.arrive(data)
    d.arrive([(10_000, "end", T0 + dt.timedelta(days=30), 0)])
    count = [F.count("id").alias("n"), F.sum("v").alias("v")]
    stream = E.run_sessions(spark, d.base, SCHEMA, "ts", 0, ["k"], count, 900).collect()
    batch = S.sessions(spark.createDataFrame(data, SCHEMA), ["k"], "ts", "id", 900, count).collect()
    form = lambda rs: sorted(repr((r.k, r.session_start, r.session_end, r.n, r.v)) for r in rs)
    assert form(stream) == form(batch)
