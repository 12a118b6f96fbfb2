"""Keyed state with timers: running accounts against brute force, restarts, state that ends."""

import datetime as dt
import random
from decimal import Decimal
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import types as T

from costmart.session import shared_dir
from costmart.streaming import eventtime as E
from costmart.streaming import keyed

T0 = dt.datetime(2025, 1, 1)
SCHEMA = (T.StructType().add("id", "long").add("k", "string").add("key", "long")
          .add("ts", "timestamp_ntz").add("v", "double"))
DELAY, VISITS, PERIOD, TTL = 1800, 3, 1200, 7200


class Stream:
    def __init__(self, spark):
        self.spark, self.n, self.base = spark, 0, shared_dir(spark, "test-keyed")

    def arrive(self, data):
        (self.spark.createDataFrame(data, SCHEMA).repartition(3)
         .write.parquet(f"{self.base}/in/drop={self.n}"))
        self.n += 1
        E.run_gate(self.spark, f"{self.base}/in/drop=*", SCHEMA, self.base, "ts", DELAY)
        return self.accounts()

    def accounts(self, visits=VISITS):
        return keyed.run_accounts(self.spark, self.base, SCHEMA, "ts", DELAY, ["k", "key"], "id",
                                  "v", visits, PERIOD, TTL)

    def state(self, name):
        return (self.spark.read.format("statestore").option("stateVarName", name)
                .load(f"{self.base}/_accounts"))


def row(minute, i, k="x", key=1, v=1.0):
    return (i, k, key, None if minute is None else T0 + dt.timedelta(minutes=minute), v)


def told(df):
    return sorted(repr((r.k, r.key, r.id, r.ts, r.n, r.total, r.alert)) for r in df.collect())


def brute(data, passed, visits=VISITS):
    out = []
    for key in {r[1:3] for r in data}:
        times, n, total = [], 0, Decimal(0)
        for i, k, j, at, v in sorted((r for r in data if r[1:3] == key), key=lambda r: (r[3], r[0])):
            if times and (at - times[-1]).total_seconds() >= TTL:
                times, n, total = [], 0, Decimal(0)
            times, n = [*times, at], n + 1
            total += Decimal(str(v or 0))
            alert = n >= visits and (at - times[-visits]).total_seconds() < PERIOD
            if at < passed:
                out.append(repr((k, j, i, at, n, total.quantize(Decimal("0.01")), alert)))
    return sorted(out)


def test_accounts_equal_brute_force_over_restarts(spark):
    rng = random.Random(4)
    s, taken, top = Stream(spark), [], None
    for step in range(3):
        data = []
        for i in range(150):                          # a third of the rows have one key
            k = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None, "a\",\"key\":2"])
            minute = rng.choice([None, *[step * 200 + rng.randrange(-60, 200)] * 20])
            data.append(row(minute, step * 150 + i, k, rng.choice([1, None]) if k != "hot" else 1,
                            rng.choice([None, 0.25, 10.5, -3.75])))
        data.append(data[0])                          # a repeated row counts twice
        bound = None if top is None else top - dt.timedelta(seconds=DELAY)
        taken += [r for r in data if r[3] and (bound is None or r[3] > bound)]
        top = max([r[3] for r in data if r[3]] + ([top] if top else []))
        got = s.arrive(data)
        assert told(got) == brute(taken, top - dt.timedelta(seconds=DELAY))
    assert told(s.accounts()) == told(got)            # run again without new rows
    assert any("True)" in r for r in told(got)) and got.columns == ["k", "key", "id", "ts", "n",
                                                                    "total", "alert"]


def test_state_ends_and_holds_the_delay_only(spark):
    s = Stream(spark)
    s.arrive([row(m, m, "once") for m in range(30)])
    for step in range(1, 4):
        s.arrive([row(300 * step + m, 1000 * step + m, "x") for m in range(60)])
    accounts = s.state("account").collect()
    assert len(accounts) == 1                         # the idle key's account is gone
    waiting = s.state("waiting").collect()
    assert len(waiting) == 31                         # rows of the last half hour
    assert s.state("recent").count() == VISITS - 1


class Value:
    def __init__(self):
        self.held = None

    def get(self):
        return self.held

    def exists(self):
        return self.held is not None

    def update(self, new):
        self.held = new

    def clear(self):
        self.held = None


class Items(Value):
    def get(self):
        return iter(self.held or [])

    def put(self, new):
        self.held = list(new)

    def appendList(self, new):
        self.held = [*(self.held or []), *new]


class Handle:
    def __init__(self):
        self.timers = set()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard

    def getListState(self, name, schema):
        return Items()

    def getValueState(self, name, schema):
        return Value()


def test_state_is_read_once_a_batch():
    rng, handle, p = random.Random(5), Handle(), keyed._Accounts(3, 60_000_000, 200_000_000)
    p.init(handle)
    rows, mark, out, fired = [], 0, [], 0
    reads = []
    get = p.waiting.get
    p.waiting.get = lambda: reads.append(mark) or get()
    for step in range(12):
        if step not in (7, 8, 9):                     # here the key is idle and its account ends
            part = pd.DataFrame({"at": [(mark + rng.randrange(1, 200_000)) * 1000 for _ in range(9)],
                                 "id": range(step * 9, step * 9 + 9), "amount": 1})
            rows += part["at"].tolist()
            p.handleInputRows(("x",), iter([part]), None)
        mark += 100_000
        for t in sorted(t for t in handle.timers if t < mark):
            handle.timers.remove(t)
            values = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
            out += list(p.handleExpiredTimer(("x",), values, None))
            fired += 1
    assert fired > len(reads) == len(set(reads))
    assert [t for o in out for t in o["at"]] == sorted(t for t in rows if t < mark * 1000)


def test_one_visit_alerts_and_empty_stream(spark):
    s = Stream(spark)
    assert told(s.arrive([])) == []
    s = Stream(spark)
    s.accounts = lambda: Stream.accounts(s, visits=1)
    got = s.arrive([row(0, 1), row(1, 2), row(500, 3, "end")]).collect()
    assert [(r.id, r.alert) for r in sorted(got, key=lambda r: r.id)] == [(1, True), (2, True)]


def test_session_setting_is_kept(spark):
    before = spark.conf.get(keyed.PROVIDER, None)
    s = Stream(spark)
    s.arrive([row(0, 1)])
    assert spark.conf.get(keyed.PROVIDER, None) == before
