"""Queries of ``operators.sets``, ``operators.semistructured`` and ``functions.periods``."""

from __future__ import annotations

from pyspark.sql import functions as F

from costmart.functions.periods import register_period_rows
from costmart.operators import semistructured as J
from costmart.operators import sets as S
from costmart.plans.catalog import query
from costmart.plans.oracle import with_billing
from costmart.plans.ordered import _table
from costmart.schema import DEFAULT_COLUMNS as C
from costmart.sources.fixture import billing

_FEEDS_SQL = """
a AS (SELECT dokter, poli, nullif(jenis_layanan, 'N') AS layanan FROM billing WHERE flag = 'F'),
b AS (SELECT dokter, poli, nullif(jenis_layanan, 'N') AS layanan FROM billing WHERE flag <> 'F')"""


def _feed_sides(spark, sf_dir):
    """Doctor, clinic and service (NULL for one of them) of the rows of either flag."""
    rows = billing(spark, sf_dir).select(
        "dokter", F.col(C.clinic).alias("poli"),
        F.nullif(F.col("jenis_layanan"), F.lit("N")).alias("layanan"), "flag")
    return rows.where("flag = 'F'").drop("flag"), rows.where("flag <> 'F'").drop("flag")


@query("multiset_intersect", with_billing("SELECT * FROM a INTERSECT ALL SELECT * FROM b", _FEEDS_SQL))
def q_multiset_intersect(spark, sf_dir):
    """Rows that both parts have, as often as both have them; NULL equals NULL."""
    return S.intersect_all(*_feed_sides(spark, sf_dir))


@query("multiset_except", with_billing("SELECT * FROM b EXCEPT ALL SELECT * FROM a", _FEEDS_SQL))
def q_multiset_except(spark, sf_dir):
    """Rows of the second part beyond those of the first, copies counted."""
    first, second = _feed_sides(spark, sf_dir)
    return S.except_all(second, first)


@query("not_in_urgent", """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def q_not_in_urgent(spark, sf_dir):
    """Customers without an urgent order, with the meaning of NOT IN."""
    urgent = _table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return S.not_in(customers, "c_custkey", urgent, "o_custkey")


#: The given properties are all of one form; here some are cut short, wrapped, missing, or of
#: another kind, and views carry a second key.
_PROPS_SQL = """
WITH e AS (
    SELECT event_id, ts, CASE
        WHEN event_id % 40 = 0 THEN left(props, length(props) - 1)
        WHEN event_id % 40 = 1 THEN '[' || props || ']'
        WHEN event_id % 40 = 2 THEN NULL
        WHEN event_type = 'error' THEN regexp_replace(props, '([0-9]+)', '"\\1"')
        WHEN event_type = 'view' THEN replace(props, '}', ', "user": "u' || user_id || '"}')
        ELSE props END AS props FROM events),
j AS (SELECT *, CASE WHEN props IS NULL THEN 'missing' WHEN NOT json_valid(props) THEN 'bad'
                     WHEN json_type(props) <> 'OBJECT' THEN 'not_object' ELSE 'object' END AS state
      FROM e),
k AS (SELECT *, unnest(json_keys(props)) AS key FROM j WHERE state = 'object'),
x AS (SELECT *, json_extract_string(props, '$.' || key) AS value,
             CASE json_type(props, '$.' || key) WHEN 'UBIGINT' THEN 'BIGINT'
                  WHEN 'VARCHAR' THEN 'STRING' END AS kind FROM k)
"""


def _props(spark, sf_dir):
    text, at = F.col("props"), F.col("event_id") % 40
    return _table(spark, sf_dir, "events").select(
        "event_id", "ts",
        F.when(at == 0, F.expr("left(props, length(props) - 1)"))
        .when(at == 1, F.concat(F.lit("["), text, F.lit("]"))).when(at == 2, None)
        .when(F.col("event_type") == "error", F.regexp_replace(text, "([0-9]+)", '"$1"'))
        .when(F.col("event_type") == "view", F.replace(
            text, F.lit("}"), F.concat(F.lit(', "user": "u'), "user_id", F.lit('"}'))))
        .otherwise(text).alias("props"))


@query("props_values", _PROPS_SQL + """
SELECT event_id, state,
       CASE WHEN state = 'object' THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
       CASE WHEN state = 'object' THEN json_extract_string(props, '$.user') END AS user_name
FROM j""")
def q_props_values(spark, sf_dir):
    """Each event's JSON state and two values read by path."""
    rows = J.extract(_props(spark, sf_dir), "props",
                     {"k": ("$.k", "long"), "user_name": ("$.user", "string")})
    return J.parsed(rows, "props").select("event_id", F.col("json_state").alias("state"), "k", "user_name")


@query("props_statistics", _PROPS_SQL + """
SELECT key, kind, count(*) AS n_rows, count(DISTINCT value) AS n_distinct,
       min(value) AS min_value, max(value) AS max_value FROM x GROUP BY key, kind""")
def q_props_statistics(spark, sf_dir):
    """Per key and kind of value: rows, distinct values, least and greatest."""
    return J.key_statistics(_props(spark, sf_dir), "props")


@query("props_drift", _PROPS_SQL + """,
odd AS (SELECT ts, NULL AS key, state AS found FROM j WHERE state <> 'object'
        UNION ALL SELECT ts, key, kind FROM x WHERE NOT (key = 'k' AND kind = 'BIGINT')
                                                AND NOT (key = 'user' AND kind = 'STRING')
        UNION ALL SELECT ts, 'user', 'absent' FROM j WHERE state = 'object'
                  AND NOT list_contains(json_keys(props), 'user'))
SELECT strftime(ts, '%Y-%m-%d') AS period, key, found, count(*) AS n_rows FROM odd
GROUP BY ALL""")
def q_props_drift(spark, sf_dir):
    """Departures from the expected keys and kinds per day; bad and missing JSON counted."""
    return J.drift(_props(spark, sf_dir), "props", {"k": "BIGINT", "user": "STRING"},
                   F.date_format("ts", "yyyy-MM-dd"))


@query("period_rows", """
WITH s AS (SELECT l_orderkey AS id, l_linenumber AS line,
                  CAST(least(o_orderdate, l_shipdate) AS DATE) AS a,
                  CAST(greatest(o_orderdate, l_shipdate) AS DATE) AS b
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT *, CAST(sum(date_diff('day', a, b) + 1) OVER (PARTITION BY id ORDER BY line, a, b
                     ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_days FROM s),
m AS (SELECT *, unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH)) AS p FROM r)
SELECT strftime(p, '%Y-%m') AS period, count(*) AS n_lines,
       CAST(sum(date_diff('day', greatest(a, CAST(p AS DATE)), least(b, last_day(p))) + 1) AS BIGINT)
           AS days,
       CAST(sum(running_days) AS BIGINT) AS running_days, count(DISTINCT id) AS n_orders
FROM m GROUP BY 1""")
def q_period_rows(spark, sf_dir):
    """Days between order and shipment per month: each line's span as month rows, by a table
    function in SQL. A bucket holds its ids whole, so an order counts where it opens a month."""
    register_period_rows(spark, opens=True)
    # Many buckets a task, so that the tasks are alike.
    buckets = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = (_table(spark, sf_dir, "lineitem")
             .join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
             .select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
                     F.least("o_orderdate", "l_shipdate").cast("date").alias("first_day"),
                     F.greatest("o_orderdate", "l_shipdate").cast("date").alias("last_day"))
             .withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets))))
    return spark.sql("""
        SELECT period, count(*) AS n_lines, sum(days) AS days, sum(running_days) AS running_days,
               count_if(opens AND id IS NOT NULL) AS n_orders
        FROM period_rows(TABLE(SELECT * FROM {spans})
                         PARTITION BY bucket ORDER BY (id, line, first_day, last_day))
        GROUP BY period""", spans=spans)
