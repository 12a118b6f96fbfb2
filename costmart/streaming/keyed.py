"""Keyed state with timers over an event-time stream: running account and alerts per key.

The rows are those that ``streaming.eventtime.run_gate`` has accepted. They may
come out of order within the allowed delay, so a row waits in its key's list
state until the watermark has passed it; a timer then releases the waiting rows
in the order (time, id). Each is put out once, with what the key's account holds
after it:

* ``n`` and ``total``: rows and sum of amounts so far (value state);
* ``alert``: whether this row and the ``visits`` - 1 before it lie within less
  than ``period_seconds`` (list state of the last ``visits`` - 1 times).

An account lives ``ttl_seconds`` of event time after its last row. A row that
comes later opens a new one, and a timer clears the state when the watermark
shows that none can come earlier. Spark's own time-to-live counts processing
time, by which a replay would decide otherwise.

A key's state is read once a batch, at the first of its timers that are due; that
one does all the work, and the others of the batch are passed over.

The state of a key is its account, ``visits`` - 1 times and the rows of the last
``delay_seconds``, whatever the age of the stream. The rows of a key are handled
in one task, batch by batch, as their order matters; its memory is bounded by
the rows of one delay. Rows not yet passed by the watermark stay in the state
for the next run and are not in the result.

Defined cases: a null key is a key like any other, a null amount counts as 0,
rows without a time are with the gate's late rows, rows that repeat an id are
rows of their own, an empty stream gives an empty table.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from costmart.streaming.eventtime import accepted_stream, run_append

#: Amounts are kept as whole hundredths.
SCALE = 2
RELEASED = "key string, id long, at long, n long, total long, alert boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Accounts(StatefulProcessor):
    """Waiting rows, account and last times of each key; all times in microseconds."""

    def __init__(self, visits: int, period: int, ttl: int):
        self.visits, self.period, self.ttl = visits, period, ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, amount long")
        self.account = handle.getValueState("account", "last long, n long, total long")
        self.recent = handle.getListState("recent", "at long")
        # Keys whose timers have been seen to at this watermark.
        self.seen, self.seen_at = set(), None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            self.waiting.appendList(list(zip(part["at"].tolist(), part["id"].tolist(),
                                             part["amount"].tolist())))
            low = int(part["at"].min())
            first = low if first is None else min(first, low)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        if self.seen_at != passed:
            self.seen, self.seen_at = set(), passed
        if key[0] in self.seen:                       # the first timer did all that is due
            return
        self.seen.add(key[0])
        held = [tuple(r) for r in self.waiting.get()]
        ready = sorted(r for r in held if r[0] < passed)
        later = [r for r in held if r[0] >= passed]
        account = self.account.get()
        if ready:
            account, out = self._apply(key[0], ready, account)
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            yield out
        due = [min(later)[0]] if later else []
        if account is not None:
            if account[0] + self.ttl <= passed:
                self.account.clear()
                self.recent.clear()
            else:
                if ready:
                    self.account.update(account)
                due.append(account[0] + self.ttl)
        if due:
            self._wake(min(due))

    def _wake(self, at: int) -> None:
        # A timer fires when the watermark, in whole milliseconds, is past it.
        self.handle.registerTimer(at // 1000)

    def _apply(self, key: str, ready: list, account: tuple | None):
        """The rows with the account after each; the account and the last times are moved on."""
        last, n, total = account or (None, 0, 0)
        recent = deque([r[0] for r in self.recent.get()] if account else [],
                       maxlen=max(self.visits - 1, 1))
        out = []
        for at, row, amount in ready:
            if last is not None and at - last >= self.ttl:
                n, total = 0, 0
                recent.clear()
            n, total, last = n + 1, total + amount, at
            # With one visit the row itself is the first of the visits.
            start = at if self.visits == 1 else recent[0] if n >= self.visits else None
            out.append((key, row, at, n, total, start is not None and at - start < self.period))
            recent.append(at)
        self.recent.put([(t,) for t in recent])
        names = ["key", "id", "at", "n", "total", "alert"]
        return (last, n, total), pd.DataFrame(out, columns=names)


def run_accounts(spark: SparkSession, base: str, schema: T.StructType, time: str,
                 delay_seconds: int, keys: Sequence[str], id_col: str, amount: str, visits: int,
                 period_seconds: int, ttl_seconds: int, name: str = "accounts") -> DataFrame:
    """keys, id, time, n, total, alert of every row that the watermark has passed.

    Works off the accepted rows of ``base`` and goes on from its checkpoint.
    """
    rows = accepted_stream(spark, base, schema, time, delay_seconds)
    fields = T.StructType([schema[k] for k in keys])
    # Text of the keys: null keys take no other form in the state.
    key = F.to_json(F.struct(*(F.col(f"`{k}`") for k in keys)))
    cents = F.coalesce(F.col(f"`{amount}`"), F.lit(0)).cast(f"decimal(18,{SCALE})")
    told = rows.select(
        key.alias("key"), F.col(f"`{id_col}`").cast("long").alias("id"),
        F.unix_micros(f"`{time}`").alias("at"),
        (cents * 10 ** SCALE).cast("long").alias("amount"), F.col(f"`{time}`").alias("event_time"))
    found = told.groupBy("key").transformWithStateInPandas(
        _Accounts(visits, period_seconds * 1_000_000, ttl_seconds * 1_000_000),
        RELEASED, "Append", "EventTime")
    parts = F.from_json("key", fields)
    result = found.withColumn("key", parts).select(
        *(F.col("key")[k].alias(k) for k in keys), F.col("id").alias(id_col),
        F.timestamp_micros("at").alias(time), "n",
        (F.col("total").cast("decimal(20,0)") / 10 ** SCALE).cast(f"decimal(18,{SCALE})")
        .alias("total"), "alert")
    # Several states per key need the RocksDB store; the session keeps its own setting.
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return run_append(result, base, name)
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
