"""Queries of ``operators.ordered``: as-of and interval joins, smaller counts, running measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from costmart.operators import ordered as O
from costmart.plans.catalog import query
from costmart.plans.oracle import with_billing
from costmart.schema import DEFAULT_COLUMNS as C
from costmart.sources.fixture import billing


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("asof_last_view", """
SELECT p.event_id, p.user_id, p.ts, v.event_id AS last_event_id, v.ts AS last_ts,
       v.value AS last_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, max_by(value, event_id) AS value
                FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v
ON p.user_id = v.user_id AND p.ts >= v.ts""")
def q_asof_last_view(spark, sf_dir):
    """Each purchase with the user's last view at or before it."""
    events = _table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = events.where("event_type = 'view'")
    return O.asof_join(bought, seen, ["user_id"], "ts", "ts", ["event_id", "ts", "value"],
                       tie_break="event_id")


@query("asof_last_order", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.o_custkey,
       p.o_orderkey AS last_o_orderkey, p.o_orderdate AS last_o_orderdate,
       p.o_totalprice AS last_o_totalprice
FROM (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey) l
ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey,
                       max_by(o_totalprice, o_orderkey) AS o_totalprice
                FROM orders GROUP BY o_custkey, o_orderdate) p
ON l.o_custkey = p.o_custkey AND l.l_shipdate > p.o_orderdate""")
def q_asof_last_order(spark, sf_dir):
    """Each line with its customer's last order before the shipping time."""
    orders = _table(spark, sf_dir, "orders")
    lines = (_table(spark, sf_dir, "lineitem")
             .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
             .join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"),
                   "l_orderkey"))
    return O.asof_join(lines, orders, ["o_custkey"], "l_shipdate", "o_orderdate",
                       ["o_orderkey", "o_orderdate", "o_totalprice"], tie_break="o_orderkey",
                       strict=True)


@query("interval_views", """
SELECT p.event_id, v.event_id AS near_event_id, v.ts AS near_ts
FROM events p JOIN events v ON p.user_id = v.user_id
 AND v.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts + INTERVAL 1 HOUR
WHERE p.event_type = 'purchase' AND v.event_type = 'view'""")
def q_interval_views(spark, sf_dir):
    """Pairs of a purchase and the user's views from six hours before to one hour after it."""
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    found = O.interval_join(events.where("event_type = 'purchase'"),
                            events.where("event_type = 'view'"), "ts", "ts", 6 * 3600, 3600,
                            ["user_id"])
    return found.select("event_id", "near_event_id", "near_ts")


@query("interval_counts", """
SELECT p.event_id, count(v.event_id) AS n_near,
       CAST(sum(CAST(v.value AS DECIMAL(18,2))) AS DOUBLE) AS value_near
FROM events p JOIN events v ON v.ts BETWEEN p.ts - INTERVAL 30 MINUTE AND p.ts + INTERVAL 30 MINUTE
WHERE p.event_type = 'error' AND v.event_type <> 'error'
GROUP BY p.event_id""")
def q_interval_counts(spark, sf_dir):
    """For each error, the other events of any user within 30 minutes: number and value."""
    events = _table(spark, sf_dir, "events").select("event_id", "ts", "value", "event_type")
    found = O.interval_join(events.where("event_type = 'error'"),
                            events.where("event_type <> 'error'"), "ts", "ts", 1800, 1800,
                            totals={"n": F.col("event_id").isNotNull().cast("long"),
                                    "near": F.col("value").cast("decimal(18,2)")})
    return found.groupBy("event_id").agg(
        F.sum("n").alias("n_near"), F.sum("near").cast("double").alias("value_near"))


@query("smaller_lines", """
SELECT o_orderkey, o_totalprice,
       (SELECT count(*) FROM lineitem WHERE l_extendedprice < o_totalprice) AS n_smaller
FROM orders""")
def q_smaller_lines(spark, sf_dir):
    """Each order with the number of lines of the whole table that cost less than it."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return O.count_smaller(orders, _table(spark, sf_dir, "lineitem"), "o_totalprice",
                           "l_extendedprice")


@query("running_cost", with_billing("""
SELECT poli, tanggal, CAST(cost AS DOUBLE) AS cost,
       CAST(sum(cost) OVER (PARTITION BY poli ORDER BY tanggal) AS DOUBLE) AS running_clinic,
       CAST(sum(cost) OVER (ORDER BY tanggal, poli) AS DOUBLE) AS running_all,
       CAST(sum(cost) OVER w AS DOUBLE) AS week_cost,
       CAST(sum(cost) OVER w AS DOUBLE) / count(cost) OVER w AS week_mean
FROM daily WINDOW w AS (PARTITION BY poli ORDER BY tanggal
                        RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""", """
daily AS (SELECT poli, tanggal, sum(biaya) AS cost FROM billing
          WHERE poli IS NOT NULL GROUP BY poli, tanggal)"""))
def q_running_cost(spark, sf_dir):
    """Daily cost per clinic: running totals per clinic and overall, 7-day sum and mean."""
    daily = (billing(spark, sf_dir).where(F.col(C.clinic).isNotNull())
             .groupBy(F.col(C.clinic).alias("poli"), F.to_date(C.time).alias("tanggal"))
             .agg(F.sum(C.cost).alias("cost")))
    clinic = O.running_total(daily, "cost", ["tanggal"], ["poli"], "running_clinic")
    both = O.running_total(clinic, "cost", ["tanggal", "poli"], name="running_all")
    week = O.rolling_sum(both, "cost", "tanggal", 7, ["poli"], name="week")
    return week.select(
        "poli", "tanggal",
        *(F.col(c).cast("double").alias(c) for c in ("cost", "running_clinic", "running_all")),
        F.col("week").cast("double").alias("week_cost"),
        (F.col("week").cast("double") / F.col("week_n")).alias("week_mean"))
