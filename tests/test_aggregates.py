"""A1–A3 and null-key handling."""
from costmart.operators import aggregates, marts
from costmart.schema import UNKNOWN


def _rows(df, key):
    return {r[key]: r for r in df.collect()}


def test_mode_tie_goes_to_smallest(spark):
    df = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "b", 3), ("k", "a", 4)],
                               "key string, v string, o int")
    got = aggregates.mode_or(df, ["key"], "v", "m").collect()
    assert [(r.key, r.m) for r in got] == [("k", "a")]


def test_mode_all_null_defaults_in_patient_summary(spark):
    df = spark.createDataFrame(
        [("p", 1, None, "c1", "d1", "10.00", 1), ("p", 1, None, "c1", "d1", "20.00", 2)],
        "nama_pasien string, id_pasien long, jenis_jaminan string, poli string, dokter string,"
        " biaya string, o int").selectExpr("*", "cast(biaya as decimal(18,2)) as b2") \
        .drop("biaya").withColumnRenamed("b2", "biaya")
    out = marts.patient_summary(df, order_by=["o"]).collect()
    assert len(out) == 1
    r = out[0]
    assert r.main_payer == UNKNOWN
    assert r.clinics == "c1" and r.doctors == "d1"
    assert r.total_cost == 30.0 and r.mean_cost == 15.0 and r.n_visits == 2


def test_first_k_distinct_in_row_order(spark):
    rows = [("k", v, o) for o, v in enumerate(["z", "y", "z", None, "x", "w", "y"])]
    df = spark.createDataFrame(rows, "key string, v string, o int").repartition(5)
    got = aggregates.first_k_distinct(df, ["key"], "v", 3, ["o"], "out").collect()
    assert got[0].out == "z, y, x"
    got2 = aggregates.first_k_distinct(df, ["key"], "v", 2, ["o"], "out").collect()
    assert got2[0].out == "z, y"


def test_top_k_values_ties_and_nulls(spark):
    rows = [("k", v) for v in ["b", "b", "a", "a", "c", None, None, None, "d"]] + [(None, "a")]
    df = spark.createDataFrame(rows, "key string, v string")
    got = aggregates.top_k_values(df, ["key"], "v", 3, "out").collect()
    assert [(r.key, r.out) for r in got] == [("k", "a, b, c")]


def test_null_group_key_dropped(spark):
    df = spark.createDataFrame([("x",), (None,), ("x",), ("y",)], "poli string")
    got = {r.poli: r.n_rows for r in marts.top_n(df, "poli", 10).collect()}
    assert got == {"x": 2, "y": 1}


def test_count_of_ids_skips_null(spark):
    df = spark.createDataFrame([("x", "p", "1.00"), ("x", None, "2.00")],
                               "poli string, id_pasien string, biaya string") \
        .selectExpr("poli", "id_pasien", "cast(biaya as decimal(18,2)) as biaya")
    r = marts.mean_cost_by_clinic(df).collect()[0]
    assert r.n_rows == 1 and r.mean_cost == 1.5


def test_hot_key_bounded(spark):
    """One key with most of the rows still yields k values (WindowGroupLimit)."""
    from pyspark.sql import functions as F
    df = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 97).cast("string"))
        .alias("key"), (F.col("id") % 13).cast("string").alias("v"))
    out = aggregates.top_k_values(df, ["key"], "v", 3, "out")
    plan = out._jdf.queryExecution().executedPlan().toString()
    r = {x.key: x.out for x in out.collect()}
    assert len(r["hot"].split(", ")) == 3
    assert "WindowGroupLimit" in plan
