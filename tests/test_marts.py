"""Marts: edge cases and invariants on the sf0.001 billing view."""
from pyspark.sql import functions as F

from costmart.operators import marts
from costmart.schema import OTHER


def test_share_without_other_when_few_keys(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(8) for _ in range(i + 1)], "p string")
    out = marts.bucket_other(df, "p", 8).collect()
    assert len(out) == 8 and OTHER not in {r.p for r in out}
    assert abs(sum(r.pct for r in out) - 100.0) < 1e-9


def test_share_with_other(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(10) for _ in range(i + 1)], "p string")
    out = {r.p: r.n_rows for r in marts.bucket_other(df, "p", 8).collect()}
    assert out[OTHER] == 1 + 2 and len(out) == 9


def test_histogram_single_value(spark):
    df = spark.createDataFrame([("5.00",)] * 4, "b string").selectExpr(
        "cast(b as decimal(18,2)) as biaya")
    out = marts.histogram(df, "biaya", 50).collect()
    assert [(r.bin, r.n_rows) for r in out] == [(0, 4)]


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "biaya double")
    out = {r.bin: r.n_rows for r in marts.histogram(df, "biaya", 50).collect()}
    assert sum(out.values()) == 101 and out[49] == 3 and max(out) == 49


def test_invariants(billing_small):
    b = billing_small
    n = b.count()
    share = marts.bucket_other(b, "jenis_jaminan", 8).agg(F.sum("n_rows")).first()[0]
    assert share == b.where(F.col("jenis_jaminan").isNotNull()).count()
    hist = marts.histogram(b, "biaya", 50).agg(F.sum("n_rows")).first()[0]
    assert hist == n
    k = marts.kpis(b).first()
    trend = marts.monthly_trend(b).agg(F.sum("total_cost"), F.sum("n_rows")).first()
    assert abs(trend[0] - k.total) < 1e-6 and trend[1] == k.n_rows == n


def test_results_independent_of_partitioning(billing_small):
    b = billing_small
    for fn in (lambda d: marts.payer_summary(d), lambda d: marts.patient_summary(d),
               lambda d: marts.kpis(d), lambda d: marts.monthly_trend(d)):
        a = sorted(map(tuple, fn(b).collect()))
        c = sorted(map(tuple, fn(b.repartition(7)).collect()))
        assert a == c


def test_top_n_measure_sorted_by_mean(billing_small):
    out = marts.mean_cost_by_clinic(billing_small).collect()
    means = [r.mean_cost for r in out]
    assert len(out) == 10 and means == sorted(means, reverse=True)


def test_kpi_exact_vs_approx(billing_small):
    e = marts.kpis(billing_small).first()
    a = marts.kpis(billing_small, exact=False).first()
    assert e.total == a.total and e.n_rows == a.n_rows
    assert abs(a.n_patients - e.n_patients) <= max(3, 0.05 * e.n_patients)


def test_orders_of_results(billing_small):
    """Payers by total, descending; T3: months in time order."""
    months = [r.bulan_tahun for r in marts.monthly_trend(billing_small).collect()]
    assert months == sorted(months) and len(months) > 12
    totals = [r.total_cost for r in marts.payer_summary(billing_small).collect()]
    assert totals == sorted(totals, reverse=True)
    for f in (marts.mean_cost_by_clinic, marts.mean_cost_by_doctor, marts.mean_cost_by_payer):
        means = [r.mean_cost for r in f(billing_small).collect()]
        assert means == sorted(means, reverse=True)


def test_kpi_counts_as_text(spark):
    k = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 12345, 2345, 3456, 4567, 5678)],
                              "total double, mean double, max double, min double, n_rows long,"
                              "n_patients long, n_clinics long, n_doctors long, n_payers long")
    r = marts.kpi_display(k).first()
    assert (r.n_rows_text, r.n_patients_text) == ("12,345", "2,345")
    assert (r.n_clinics_text, r.n_doctors_text, r.n_payers_text) == ("3456", "4567", "5678")
