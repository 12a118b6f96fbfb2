"""The ``billing`` view: canonical transactions over the star-schema tables.

One row per ``lineitem``::

    lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ part ⋈ supplier

Join plan. The order side is joined to its dimensions first
(orders ⋈ customer ⋈ nation), so the fact table is shuffled once on the order
key against an already-enriched order row (one fact shuffle fewer than joining
orders and customer to the fact one by one). That join is pinned to a
sort-merge join: both sides grow with the data, and without the hint Spark's
estimate for a joined side (the product of its inputs) would make the *fact*
look like the smaller side and broadcast it at small scales. ``part`` and
``supplier`` join on their keys with no hint: Spark broadcasts such a side
only when its estimated (or, under AQE, measured) size is below
``spark.sql.autoBroadcastJoinThreshold`` and uses a sort-merge join otherwise,
so growing dimensions stay safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costmart.functions.calendar import with_calendar

# Columns that make a row unique at every scale; they fix the row order used by
# "first k distinct" and the text key used for hashing (split, sample).
ORDER_KEY = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
             "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def row_key() -> Column:
    """Text form of the unique order key (same text in DuckDB)."""
    return F.concat_ws(
        "|",
        F.date_format("l_shipdate", "yyyy-MM-dd"),
        F.col("l_orderkey").cast("string"),
        F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
    )


def billing_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed canonical transactions (no calendar columns yet)."""
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")

    order_side = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select("o_orderkey", "o_custkey", "o_orderpriority", "c_name", "n_name")
    )
    joined = (
        li.join(order_side.hint("merge"), li.l_orderkey == order_side.o_orderkey)
        .join(part, li.l_partkey == part.p_partkey)
        .join(supplier, li.l_suppkey == supplier.s_suppkey)
    )
    return joined.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("id_transaksi"),
        F.col("o_custkey").alias("id_pasien"),
        F.col("l_linenumber").alias("no_urut"),
        F.col("c_name").alias("nama_pasien"),
        F.col("l_shipdate").alias("waktu"),
        F.col("s_name").alias("dokter"),
        F.col("l_returnflag").alias("jenis_layanan"),
        F.col("p_brand").alias("poli"),
        F.col("o_orderpriority").alias("sumber_pembayaran"),
        F.when(F.col("l_linestatus") == "F", F.col("n_name")).alias("jenis_jaminan"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("biaya"),
        F.col("l_discount").alias("diskon"),
        F.col("l_linestatus").alias("flag"),
        *[F.col(c) for c in ORDER_KEY],
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``billing`` that needs the fact table only, with calendar columns.

    Every fact row has its order, part and supplier, so the rows are those of
    ``billing``; queries that need no name of a patient, clinic, doctor or
    payer read this and spare the joins.
    """
    li = table(spark, sf_dir, "lineitem")
    return with_calendar(li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("id_transaksi"),
        F.col("l_linenumber").alias("no_urut"),
        F.col("l_shipdate").alias("waktu"),
        F.col("l_returnflag").alias("jenis_layanan"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("biaya"),
        F.col("l_discount").alias("diskon"),
        F.col("l_linestatus").alias("flag"),
        *[F.col(c) for c in ORDER_KEY]))


def billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical transactions with calendar columns (the cleaned table)."""
    return with_calendar(billing_raw(spark, sf_dir))
