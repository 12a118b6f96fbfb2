"""F0–F8 and O1–O5."""
import datetime as dt

from pyspark.sql import functions as F

from costmart.operators import filters, options
from costmart.schema import ALL_CLINICS, ALL_DOCTORS


def test_reversed_range_is_full_range(billing_small):
    b = billing_small
    spec = filters.selection_spec("bulan", filters.month_selection_range(["August 1997",
                                                                           "February 1996"]))
    assert filters.apply_filters(b, spec).count() == b.count()


def test_nothing_selected_is_full_range(billing_small):
    spec = filters.selection_spec("tahun", filters.year_selection_range([]))
    assert filters.apply_filters(billing_small, spec).count() == billing_small.count()


def test_selection_order_sets_ends():
    assert filters.month_selection_range(["March 1996", "January 1996", "May 1997"]) == (
        dt.date(1996, 3, 1), dt.date(1997, 5, 1))
    assert filters.year_selection_range(["1999", "1997"]) == (dt.date(1999, 1, 1),
                                                               dt.date(1997, 12, 31))


def test_all_labels_switch_off(billing_small):
    spec = filters.FilterSpec(clinic=ALL_CLINICS, doctor=ALL_DOCTORS, payer="")
    assert filters.filter_predicate(spec, billing_small.columns) is None


def test_payer_test_skipped_without_column(billing_small):
    no_payer = billing_small.drop("jenis_jaminan")
    spec = filters.FilterSpec(payer="NATION_1")
    assert filters.apply_filters(no_payer, spec).count() == billing_small.count()


def test_date_filter_matches_brute_force(billing_small):
    spec = filters.FilterSpec(kind="tanggal", start="1996-03-15", end="1997-08-31",
                              clinic="Brand#19")
    got = filters.apply_filters(billing_small, spec).count()
    rows = billing_small.select("tanggal", "poli").collect()
    want = sum(1 for r in rows if dt.date(1996, 3, 15) <= r.tanggal <= dt.date(1997, 8, 31)
               and r.poli == "Brand#19")
    assert got == want


def test_keep_top_keys(billing_small):
    kept = filters.keep_top_keys(billing_small, "poli", 3)
    assert kept.select("poli").distinct().count() == 3


def test_options(billing_small, spark):
    b = billing_small
    bounds = options.date_bounds(b).first()
    assert bounds.min_date <= bounds.max_date
    empty = options.date_bounds(b.where("false")).first()
    assert (empty.min_date, empty.max_date) == (dt.date(2025, 1, 1), dt.date(2025, 11, 30))
    vo = options.value_options(b, "poli", ALL_CLINICS).collect()
    assert vo[0].option == ALL_CLINICS and vo[0].is_all
    assert [r.option for r in vo[1:]] == sorted(r.option for r in vo[1:])
    mo = options.month_options(b).withColumn("d", options.month_label_to_date("label")).collect()
    assert all(r.d.strftime("%Y-%m") == r.bulan_tahun for r in mo)
    yo = [r.year for r in options.year_options(b).collect()]
    assert yo == sorted(yo)
