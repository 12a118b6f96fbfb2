"""Plan shape: pushdown, pruning, top-k, bounded per-group state, no Python UDF."""
import pytest

from costmart.operators import aggregates, filters, marts
from costmart.session import shared_dir
from costmart.sources import sinks

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_is_take_ordered(billing_small):
    assert "TakeOrderedAndProject" in plan(marts.top_n(billing_small, "poli", 10))


def test_top_k_values_partial_limit(billing_small):
    p = plan(aggregates.top_k_values(billing_small, ["jenis_jaminan"], "poli", 3, "x"))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_partition_filters_on_materialized_table(spark, billing_small):
    path = shared_dir(spark, "test-table")
    sinks.write_table(billing_small, path)
    spec = filters.FilterSpec(kind="tanggal", start="1996-03-15", end="1996-05-31")
    df = filters.apply_filters(sinks.read_table(spark, path), spec)
    p = plan(df)
    assert "PartitionFilters: [isnotnull(bulan_tahun" in p
    assert df.count() == filters.apply_filters(billing_small, spec).count()


def test_column_pruning_and_pushdown(spark):
    from pyspark.sql import functions as F
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    p = plan(li.where(F.col("l_linestatus") == "F").select("l_extendedprice"))
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,F)]" in p
    assert "ReadSchema: struct<l_extendedprice:double,l_linestatus:string>" in p


@pytest.mark.parametrize("name", ["kpi_summary", "payer_summary", "patient_summary",
                                  "monthly_trend", "payer_share", "cost_histogram",
                                  "clean_rows", "feature_table", "regression_metrics"])
def test_no_python_udf(spark, name):
    import __spark_entry__ as entry
    p = plan(entry.queries()[name](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas"):
        assert bad not in p


def test_no_cartesian_or_nested_loop(spark):
    import __spark_entry__ as entry
    from costmart.plans import catalog
    for name in catalog.QUERIES:
        if name.startswith("forest_"):
            continue
        p = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in p, name
        assert "BroadcastNestedLoopJoin" not in p, name


def test_single_order_column_stays_hash_aggregate(billing_small):
    p = plan(marts.patient_grain(billing_small, order_by=["l_orderkey"]))
    assert "SortAggregate" not in p and "HashAggregate" in p


def test_summaries_scan_and_shuffle_the_rows_once(spark):
    from costmart.sources.fixture import billing
    for grain, summary in ((marts.patient_grain, marts.patient_summary),
                           (marts.payer_grain, marts.payer_summary)):
        rows = billing(spark, "/root/testdata/sf0.01")    # not the cached fixture
        base, own = plan(rows), plan(grain(rows))
        assert own.count("lineitem.parquet") == base.count("lineitem.parquet") == 1
        assert own.count("Exchange hashpartitioning") == \
            base.count("Exchange hashpartitioning") + 1
        assert "lineitem.parquet" not in plan(summary(rows))


def test_patient_lists_take_one_shuffle(spark, billing_small):
    from costmart.sources.fixture import ORDER_KEY
    path = shared_dir(spark, "test-rows")
    billing_small.write.parquet(path)
    lists = marts._first_lists(spark.read.parquet(path), ["nama_pasien", "id_pasien"],
                               marts.DEFAULT_COLUMNS, ORDER_KEY, 1)
    assert plan(lists).count("Exchange hashpartitioning") == 1
    # A sort over the summary finds a table, so its sample does not run the steps again.
    assert "Exchange" not in plan(marts.patient_summary(billing_small, order_by=ORDER_KEY))


def test_options_read_the_fact_table_only(spark):
    import __spark_entry__ as entry
    for name in ("date_bounds", "month_options", "year_options", "calendar_features",
                 "train_test_split", "filter_month_selection"):
        p = plan(entry.queries()[name](spark, SF))
        assert "Join" not in p and "lineitem.parquet" in p, name


def test_features_do_not_shuffle_rows_on_a_code(spark):
    import __spark_entry__ as entry
    p = plan(entry.queries()["feature_table"](spark, SF))
    assert "hashpartitioning(_code_key" not in p


def test_samples_are_top_k(spark):
    import __spark_entry__ as entry
    for name in ("sample_pairs", "prediction_examples", "ideal_line"):
        p = plan(entry.queries()[name](spark, SF))
        assert "TakeOrderedAndProject" in p and "rangepartitioning" not in p, name
