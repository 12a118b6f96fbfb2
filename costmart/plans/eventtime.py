"""Queries of ``streaming.eventtime`` and ``operators.sessions`` over the events table.

The stream queries replay the table in drops of ten days by arrival. Each tenth
event arrives twelve days after its time, so some rows are late; after each drop
both steps run anew from their checkpoints.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from costmart.operators.sessions import sessions
from costmart.plans.catalog import query
from costmart.plans.ordered import _table
from costmart.session import shared_dir
from costmart.streaming import eventtime as E
from costmart.streaming import keyed

DELAY = 2 * 86400
GAP = 6 * 3600
#: Accounts: idle time after which one ends, visits of an alert and the time they fall in.
IDLE, VISITS, PERIOD = 36 * 3600, 5, 86400

#: Rows with their drop, the bound of each drop, and what the gate accepts.
GATE_SQL = f"""
WITH arrived AS (
    SELECT *, CAST(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)
        + CASE WHEN event_id % 10 = 0 THEN 12 * 86400000000 ELSE 0 END)
        / 864000000000) AS BIGINT) AS d FROM events),
bounds AS (SELECT d, max(max(epoch_us(ts))) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING
                  AND 1 PRECEDING) - {DELAY * 1_000_000} AS bound
           FROM arrived GROUP BY d),
judged AS (SELECT a.*, b.bound IS NULL OR epoch_us(ts) > b.bound AS ok
           FROM arrived a JOIN bounds b USING (d)),
accepted AS (SELECT * FROM judged WHERE ok),
mark AS (SELECT epoch_ms(max(ts)) * 1000 - {DELAY * 1_000_000} AS w FROM accepted)
"""


def replay(spark, sf_dir, step):
    """The gate and ``step`` run over each drop in turn: (folder, schema, the last step's result)."""
    events = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    base, schema = shared_dir(spark, "events-stream"), events.schema
    first = events.agg(F.min(F.unix_micros("ts"))).first()[0] or 0
    delay = F.when(F.col("event_id") % 10 == 0, 12 * 86_400_000_000).otherwise(0)
    drop = F.floor((F.unix_micros("ts") - first + delay) / 864_000_000_000)
    drops = events.withColumn("_drop", drop)
    result = None
    for (d,) in drops.select("_drop").distinct().orderBy("_drop").collect():
        drops.where(F.col("_drop") == d).drop("_drop").write.parquet(f"{base}/arrived/drop={d}")
        E.run_gate(spark, f"{base}/arrived/drop=*", schema, base, "ts", DELAY)
        result = step(base, schema)
    return base, schema, result


def _plain_time(df):
    return df.select(*(F.col(f.name).cast("timestamp_ntz").alias(f.name)
                       if f.dataType.typeName() == "timestamp" else F.col(f.name)
                       for f in df.schema))


def _counts_and_value():
    return [F.count(F.lit(1)).alias("n"),
            F.sum(F.col("value").cast("decimal(18,2)")).alias("total")]


def _window_sql(start: str, extra: str = "") -> str:
    return GATE_SQL + f"""
SELECT event_type, s AS window_start, s + INTERVAL 1 DAY AS window_end, count(*) AS n,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM (SELECT *, {start} AS s FROM accepted {extra})
WHERE epoch_us(s + INTERVAL 1 DAY) <= (SELECT w FROM mark)
GROUP BY event_type, s"""


@query("stream_tumbling", _window_sql("date_trunc('day', ts)"))
def q_stream_tumbling(spark, sf_dir):
    """Events and value per day and type, from a stream with late rows; closed windows only."""
    step = lambda base, schema: E.run_windows(
        spark, base, schema, "ts", DELAY, ["event_type"],
        _counts_and_value(), "1 day")
    return _plain_time(replay(spark, sf_dir, step)[2].withColumn("total", F.col("total").cast("double")))


@query("stream_sliding", _window_sql(
    "time_bucket(INTERVAL 12 HOUR, ts) - k * INTERVAL 12 HOUR", ", (VALUES (0), (1)) v(k)"))
def q_stream_sliding(spark, sf_dir):
    """The same for windows of a day that begin every twelve hours."""
    step = lambda base, schema: E.run_windows(
        spark, base, schema, "ts", DELAY, ["event_type"],
        _counts_and_value(), "1 day", "12 hours")
    return _plain_time(replay(spark, sf_dir, step)[2].withColumn("total", F.col("total").cast("double")))


@query("stream_late", GATE_SQL + "SELECT event_id, user_id, ts, d AS batch FROM judged WHERE NOT ok")
def q_stream_late(spark, sf_dir):
    """The late rows, with the batch in which they came."""
    base, schema, _ = replay(spark, sf_dir, lambda base, schema: None)
    return _plain_time(E.late_rows(spark, base, schema).select("event_id", "user_id", "ts", "batch"))


def _session_sql(rows: str, cond: str, number: str) -> str:
    return f"""
SELECT user_id, {number} min(ts) AS session_start,
       max(ts) + INTERVAL {GAP} SECOND AS session_end, count(*) AS n,
       count(*) FILTER (event_type = 'purchase') AS n_bought
FROM (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= {GAP * 1_000_000}
                         THEN 1 ELSE 0 END)
          OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sn
      FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM {rows}))
GROUP BY user_id, sn {cond}"""


def _session_counts():
    return [F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("event_type") == "purchase").alias("n_bought")]


@query("session_summary", _session_sql("events", "", "CAST(sn AS BIGINT) AS session,"))
def q_session_summary(spark, sf_dir):
    """Sessions of each user with less than six hours between events: span, events, purchases."""
    return sessions(_table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", GAP,
                    _session_counts())


@query("stream_sessions", GATE_SQL + _session_sql(
    "accepted",
    f"HAVING epoch_us(max(ts)) + {GAP * 1_000_000 - 1} <= (SELECT w FROM mark)", ""))
def q_stream_sessions(spark, sf_dir):
    """The same sessions from a stream: merged in the state, put out when closed."""
    step = lambda base, schema: E.run_sessions(
        spark, base, schema, "ts", DELAY, ["user_id"], _session_counts(), GAP)
    return _plain_time(replay(spark, sf_dir, step)[2])


@query("stream_join", GATE_SQL + f""",
p AS (SELECT * FROM accepted WHERE event_type = 'purchase'),
v AS (SELECT * FROM accepted WHERE event_type = 'view')
SELECT p.event_id, p.user_id, p.ts, v.event_id AS near_event_id, v.ts AS near_ts
FROM p LEFT JOIN v ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL {GAP} SECOND AND p.ts
WHERE v.event_id IS NOT NULL OR epoch_us(p.ts) <
      least((SELECT epoch_ms(max(ts)) FROM p), (SELECT epoch_ms(max(ts)) FROM v)) * 1000 - {DELAY * 1_000_000}""")
def q_stream_join(spark, sf_dir):
    """Purchases with the user's views of the six hours before, both from streams; purchases
    without one appear once no view can come any more."""
    step = lambda base, schema: E.run_join(
        spark, base, schema, "ts", DELAY, ["user_id"], F.col("event_type") == "purchase",
        F.col("event_type") == "view", GAP, 0)
    found = replay(spark, sf_dir, step)[2]
    return _plain_time(found.select("event_id", "user_id", "ts", "near_event_id", "near_ts"))


@query("stream_accounts", GATE_SQL + f""",
before AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev
           FROM accepted),
runs AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= {IDLE * 1_000_000}
                            THEN 1 ELSE 0 END)
             OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run
         FROM before)
SELECT user_id, event_id, ts, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS n,
       CAST(sum(CAST(coalesce(value, 0) AS DECIMAL(18,2))) OVER (w ROWS UNBOUNDED PRECEDING)
            AS DOUBLE) AS total,
       coalesce(epoch_us(ts) - epoch_us(lag(ts, {VISITS - 1}) OVER w) < {PERIOD * 1_000_000},
                false) AS alert
FROM runs WHERE epoch_us(ts) < (SELECT w FROM mark)
WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id)""")
def q_stream_accounts(spark, sf_dir):
    """Each user's running events and value, and an alert at five events within a day, from
    keyed state with timers; a user idle for 36 hours starts anew."""
    step = lambda base, schema: keyed.run_accounts(
        spark, base, schema, "ts", DELAY, ["user_id"], "event_id", "value", VISITS, PERIOD, IDLE)
    found = replay(spark, sf_dir, step)[2]
    return _plain_time(found.withColumn("total", F.col("total").cast("double")))
