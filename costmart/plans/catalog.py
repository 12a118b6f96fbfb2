"""Named queries: each ``(spark, sf_dir) -> DataFrame`` with its DuckDB oracle.

Every query reads the star-schema tables under ``sf_dir`` (through the
``billing`` view or the CSV feeds derived from it) and runs over all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costmart.functions import textfmt
from costmart.operators import aggregates, filters, marts, options
from costmart.plans.oracle import with_billing
from costmart.schema import ALL_CLINICS, ALL_DOCTORS, ALL_PAYERS, DEFAULT_COLUMNS as C, UNKNOWN
from costmart.session import materialise
from costmart.sources.fixture import ORDER_KEY, billing, lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query builder (and its oracle SQL, when SQL can express it)."""
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


MEAN = "CAST(sum(biaya) AS DOUBLE) / count(biaya)"
ORDER_SQL = ", ".join(ORDER_KEY)


# ----------------------------------------------------------------- G1 / G2 / G3
@query("kpi_summary", with_billing(f"""
SELECT CAST(sum(biaya) AS DOUBLE) AS total, {MEAN} AS mean,
       CAST(max(biaya) AS DOUBLE) AS max, CAST(min(biaya) AS DOUBLE) AS min,
       count(*) AS n_rows, count(DISTINCT id_pasien) AS n_patients,
       count(DISTINCT poli) AS n_clinics, count(DISTINCT dokter) AS n_doctors,
       count(DISTINCT jenis_jaminan) AS n_payers
FROM billing"""))
def q_kpi_summary(spark, sf_dir):
    return marts.kpis(billing(spark, sf_dir))


@query("kpi_display", with_billing(f"""
SELECT format('Rp {{:,.0f}}', total) AS total_text, format('Rp {{:,.0f}}', mean) AS mean_text,
       format('Rp {{:,.0f}}', max) AS max_text, format('Rp {{:,.0f}}', min) AS min_text,
       format('{{:,}}', n_rows) AS n_rows_text, format('{{:,}}', n_patients) AS n_patients_text,
       CAST(n_clinics AS VARCHAR) AS n_clinics_text, CAST(n_doctors AS VARCHAR) AS n_doctors_text,
       CAST(n_payers AS VARCHAR) AS n_payers_text
FROM (SELECT CAST(sum(biaya) AS DOUBLE) AS total, {MEAN} AS mean,
             CAST(max(biaya) AS DOUBLE) AS max, CAST(min(biaya) AS DOUBLE) AS min,
             count(*) AS n_rows, count(DISTINCT id_pasien) AS n_patients,
             count(DISTINCT poli) AS n_clinics, count(DISTINCT dokter) AS n_doctors,
             count(DISTINCT jenis_jaminan) AS n_payers FROM billing)"""))
def q_kpi_display(spark, sf_dir):
    """G1 + X1 + X6: the KPI row as displayed."""
    return marts.kpi_display(marts.kpis(billing(spark, sf_dir)))


def _top_sql(key: str, n: int) -> str:
    return with_billing(f"""
SELECT {key}, count(*) AS n_rows FROM billing WHERE {key} IS NOT NULL
GROUP BY {key} ORDER BY n_rows DESC, {key} LIMIT {n}""")


@query("top_clinics", _top_sql("poli", 10))
def q_top_clinics(spark, sf_dir):
    return marts.top_n(billing(spark, sf_dir), C.clinic, 10)


@query("top_doctors", _top_sql("dokter", 10))
def q_top_doctors(spark, sf_dir):
    return marts.top_n(billing(spark, sf_dir), C.doctor, 10)


@query("top_payers", _top_sql("jenis_jaminan", 10))
def q_top_payers(spark, sf_dir):
    return marts.top_n(billing(spark, sf_dir), C.payer, 10)


@query("top_payer", with_billing("""
SELECT jenis_jaminan, count(*) AS n_rows,
       CASE WHEN length(jenis_jaminan) > 20 THEN substr(jenis_jaminan, 1, 20) || '...'
            ELSE jenis_jaminan END AS label
FROM billing WHERE jenis_jaminan IS NOT NULL
GROUP BY jenis_jaminan ORDER BY n_rows DESC, jenis_jaminan LIMIT 1"""))
def q_top_payer(spark, sf_dir):
    return marts.top_value(billing(spark, sf_dir), C.payer)


# ----------------------------------------------------------------- G4 – G6
def _measure_sql(key: str, count_of: str, with_total: bool) -> str:
    total = "CAST(sum(biaya) AS DOUBLE) AS total_cost," if with_total else ""
    out = "mean_cost, total_cost, n_rows" if with_total else "mean_cost, n_rows"
    return with_billing(f"SELECT {key}, {out} FROM s", f"""
s AS (SELECT {key}, count(*) AS _n, {MEAN} AS mean_cost, {total}
             count({count_of}) AS n_rows
      FROM billing WHERE {key} IS NOT NULL GROUP BY {key}
      ORDER BY _n DESC, {key} LIMIT 10)""")


@query("mean_cost_by_clinic", _measure_sql("poli", "id_pasien", False))
def q_mean_cost_by_clinic(spark, sf_dir):
    return marts.mean_cost_by_clinic(billing(spark, sf_dir))


@query("mean_cost_by_doctor", _measure_sql("dokter", "id_pasien", False))
def q_mean_cost_by_doctor(spark, sf_dir):
    return marts.mean_cost_by_doctor(billing(spark, sf_dir))


@query("mean_cost_by_payer", _measure_sql("jenis_jaminan", "biaya", True))
def q_mean_cost_by_payer(spark, sf_dir):
    return marts.mean_cost_by_payer(billing(spark, sf_dir))


# ----------------------------------------------------------------- G7 – G11
@query("top_patients", with_billing("""
SELECT nama_pasien, CAST(sum(biaya) AS DOUBLE) AS total_cost, count(id_pasien) AS n_visits
FROM billing WHERE nama_pasien IS NOT NULL GROUP BY nama_pasien
ORDER BY sum(biaya) DESC, nama_pasien LIMIT 20"""))
def q_top_patients(spark, sf_dir):
    return marts.top_patients(billing(spark, sf_dir), 20)


def _compact_sql(x: str) -> str:
    return (f"CASE WHEN {x} >= 1e6 THEN format('Rp {{:,.1f}}M', {x} / 1e6) "
            f"ELSE format('Rp {{:,.0f}}K', {x} / 1e3) END")


@query("monthly_trend", with_billing(f"""
SELECT bulan_tahun, total_cost, mean_cost, n_rows,
       strftime(strptime(bulan_tahun || '-01', '%Y-%m-%d'), '%b %Y') AS label,
       {_compact_sql('total_cost')} AS total_label
FROM (SELECT bulan_tahun, CAST(sum(biaya) AS DOUBLE) AS total_cost, {MEAN} AS mean_cost,
             count(biaya) AS n_rows
      FROM billing WHERE bulan_tahun IS NOT NULL GROUP BY bulan_tahun)"""))
def q_monthly_trend(spark, sf_dir):
    return marts.monthly_trend(billing(spark, sf_dir))


@query("payer_share", with_billing("""
SELECT jenis_jaminan, n_rows,
       CAST(n_rows AS DOUBLE) * 100.0 / CAST(sum(n_rows) OVER () AS DOUBLE) AS pct
FROM slices""", """
counts AS (SELECT jenis_jaminan, count(*) AS n_rows FROM billing
           WHERE jenis_jaminan IS NOT NULL GROUP BY jenis_jaminan),
ranked AS (SELECT *, row_number() OVER (ORDER BY n_rows DESC, jenis_jaminan) AS rn FROM counts),
slices AS (SELECT jenis_jaminan, n_rows FROM ranked WHERE rn <= 8
           UNION ALL
           SELECT 'Lainnya' AS jenis_jaminan, CAST(sum(n_rows) AS BIGINT) AS n_rows
           FROM ranked WHERE rn > 8 HAVING count(*) > 0)"""))
def q_payer_share(spark, sf_dir):
    return marts.bucket_other(billing(spark, sf_dir), C.payer, 8)


@query("cost_histogram", with_billing("""
SELECT bin, b_lo + bin * ((b_hi - b_lo) / 50.0) AS lo,
       b_lo + (bin + 1) * ((b_hi - b_lo) / 50.0) AS hi, count(*) AS n_rows
FROM (SELECT CAST(CASE WHEN bd.b_hi = bd.b_lo THEN 0
                      ELSE least(floor((CAST(biaya AS DOUBLE) - bd.b_lo)
                                       / ((bd.b_hi - bd.b_lo) / 50.0)), 49) END AS INTEGER) AS bin,
             bd.b_lo, bd.b_hi
      FROM billing, bd WHERE biaya IS NOT NULL)
GROUP BY bin, b_lo, b_hi""", """
bd AS (SELECT min(CAST(biaya AS DOUBLE)) AS b_lo, max(CAST(biaya AS DOUBLE)) AS b_hi
       FROM billing WHERE biaya IS NOT NULL)"""))
def q_cost_histogram(spark, sf_dir):
    return marts.histogram(lines(spark, sf_dir), C.cost, 50)


# ----------------------------------------------------------------- A1 – A3
def _first_k_cte(name: str, keys: str, value: str, k: int, base: str = "billing",
                 order: str = ORDER_SQL) -> str:
    return f"""
{name}_f AS (SELECT {keys}, {value} AS v, {order},
                    row_number() OVER (PARTITION BY {keys}, {value} ORDER BY {order}) AS r
             FROM {base} WHERE {value} IS NOT NULL),
{name}_r AS (SELECT {keys}, v, row_number() OVER (PARTITION BY {keys} ORDER BY {order}, v) AS rn
             FROM {name}_f WHERE r = 1),
{name} AS (SELECT {keys}, string_agg(v, ', ' ORDER BY rn) AS {name}
           FROM {name}_r WHERE rn <= {k} GROUP BY {keys})"""


def _top_k_cte(name: str, keys: str, value: str, k: int, base: str = "billing") -> str:
    return f"""
{name}_r AS (SELECT {keys}, {value} AS v,
                    row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, {value}) AS rn
             FROM {base} WHERE {value} IS NOT NULL GROUP BY {keys}, {value}),
{name} AS (SELECT {keys}, string_agg(v, ', ' ORDER BY rn) AS {name}
           FROM {name}_r WHERE rn <= {k} GROUP BY {keys})"""


@query("first_k_distinct", with_billing(
    "SELECT dokter, first_clinics FROM first_clinics",
    "base AS (SELECT * FROM billing WHERE dokter IS NOT NULL),"
    + _first_k_cte("first_clinics", "dokter", "poli", 3, "base")))
def q_first_k_distinct(spark, sf_dir):
    b = billing(spark, sf_dir)
    return aggregates.first_k_distinct(b, [C.doctor], C.clinic, 3, ORDER_KEY, "first_clinics")


@query("top_k_per_group", with_billing(
    "SELECT poli, top_doctors FROM top_doctors",
    "base AS (SELECT * FROM billing WHERE poli IS NOT NULL),"
    + _top_k_cte("top_doctors", "poli", "dokter", 3, "base")))
def q_top_k_per_group(spark, sf_dir):
    return aggregates.top_k_values(billing(spark, sf_dir), [C.clinic], C.doctor, 3, "top_doctors")


@query("main_payer", with_billing(f"""
SELECT k.dokter, coalesce(m.main_payer, '{UNKNOWN}') AS main_payer
FROM (SELECT DISTINCT dokter FROM billing WHERE dokter IS NOT NULL) k
LEFT JOIN (SELECT dokter, v AS main_payer FROM (
             SELECT dokter, jenis_jaminan AS v,
                    row_number() OVER (PARTITION BY dokter ORDER BY count(*) DESC, jenis_jaminan) AS rn
             FROM billing WHERE dokter IS NOT NULL AND jenis_jaminan IS NOT NULL
             GROUP BY dokter, jenis_jaminan) WHERE rn = 1) m ON k.dokter = m.dokter"""))
def q_main_payer(spark, sf_dir):
    return aggregates.mode_or_default(billing(spark, sf_dir), [C.doctor], C.payer, "main_payer",
                                      UNKNOWN)


# ----------------------------------------------------------------- G12 / G13
PATIENT_SUMMARY_SQL = with_billing(f"""
SELECT t.nama_pasien, t.id_pasien, t.total_cost, t.mean_cost, t.n_visits,
       coalesce(c.clinics, '') AS clinics, coalesce(d.doctors, '') AS doctors,
       coalesce(m.main_payer, '{UNKNOWN}') AS main_payer
FROM totals t
LEFT JOIN clinics c ON t.nama_pasien = c.nama_pasien AND t.id_pasien = c.id_pasien
LEFT JOIN doctors d ON t.nama_pasien = d.nama_pasien AND t.id_pasien = d.id_pasien
LEFT JOIN mp m ON t.nama_pasien = m.nama_pasien AND t.id_pasien = m.id_pasien""", f"""
base AS (SELECT * FROM billing WHERE nama_pasien IS NOT NULL AND id_pasien IS NOT NULL),
totals AS (SELECT nama_pasien, id_pasien, CAST(sum(biaya) AS DOUBLE) AS total_cost,
                  {MEAN} AS mean_cost, count(biaya) AS n_visits
           FROM base GROUP BY nama_pasien, id_pasien),
{_first_k_cte("clinics", "nama_pasien, id_pasien", "poli", 3, "base")},
{_first_k_cte("doctors", "nama_pasien, id_pasien", "dokter", 2, "base")},
mp AS (SELECT nama_pasien, id_pasien, v AS main_payer FROM (
         SELECT nama_pasien, id_pasien, jenis_jaminan AS v,
                row_number() OVER (PARTITION BY nama_pasien, id_pasien
                                   ORDER BY count(*) DESC, jenis_jaminan) AS rn
         FROM base WHERE jenis_jaminan IS NOT NULL
         GROUP BY nama_pasien, id_pasien, jenis_jaminan) WHERE rn = 1)""")


@query("patient_summary", PATIENT_SUMMARY_SQL)
def q_patient_summary(spark, sf_dir):
    return marts.patient_summary(billing(spark, sf_dir), order_by=ORDER_KEY)


@query("payer_summary", with_billing("""
SELECT s.jenis_jaminan, total_cost, mean_cost, min_cost, max_cost, n_rows, n_patients,
       coalesce(tc.top_clinics, '') AS top_clinics, coalesce(td.top_doctors, '') AS top_doctors
FROM stats s LEFT JOIN top_clinics tc ON s.jenis_jaminan = tc.jenis_jaminan
LEFT JOIN top_doctors td ON s.jenis_jaminan = td.jenis_jaminan""", f"""
base AS (SELECT * FROM billing WHERE jenis_jaminan IS NOT NULL),
stats AS (SELECT jenis_jaminan, CAST(sum(biaya) AS DOUBLE) AS total_cost, {MEAN} AS mean_cost,
                 CAST(min(biaya) AS DOUBLE) AS min_cost, CAST(max(biaya) AS DOUBLE) AS max_cost,
                 count(biaya) AS n_rows, count(DISTINCT id_pasien) AS n_patients
          FROM base GROUP BY jenis_jaminan),
{_top_k_cte("top_clinics", "jenis_jaminan", "poli", 3, "base")},
{_top_k_cte("top_doctors", "jenis_jaminan", "dokter", 3, "base")}"""))
def q_payer_summary(spark, sf_dir):
    return marts.payer_summary(billing(spark, sf_dir))


# ----------------------------------------------------------------- C5 calendar
@query("calendar_features", with_billing("""
SELECT id_transaksi, waktu, tanggal, tahun, bulan, hari, hari_dlm_minggu, hari_dlm_bulan,
       bulan_tahun, minggu FROM billing"""))
def q_calendar_features(spark, sf_dir):
    return lines(spark, sf_dir).select(
        C.transaction, C.time, C.date, C.year, C.month, C.day, C.weekday, C.day_of_month,
        C.month_key, C.week)


# ----------------------------------------------------------------- F0 – F8
ROW_VIEW = ["id_transaksi", "tanggal", "poli", "dokter", "jenis_jaminan"]
ROW_VIEW_SQL = "id_transaksi, tanggal, poli, dokter, jenis_jaminan, CAST(biaya AS DOUBLE) AS biaya"


def _rows(df: DataFrame) -> DataFrame:
    return df.select(*ROW_VIEW, F.col(C.cost).cast("double").alias("biaya"))


@query("filter_date", with_billing(f"""
SELECT {ROW_VIEW_SQL} FROM billing
WHERE tanggal BETWEEN DATE '1996-03-15' AND DATE '1997-08-31'"""))
def q_filter_date(spark, sf_dir):
    spec = filters.FilterSpec(kind="tanggal", start="1996-03-15", end="1997-08-31")
    return _rows(filters.apply_filters(billing(spark, sf_dir), spec))


@query("filter_month", with_billing(f"""
SELECT {ROW_VIEW_SQL} FROM billing WHERE bulan_tahun BETWEEN '1998-02' AND '1998-11'"""))
def q_filter_month(spark, sf_dir):
    spec = filters.FilterSpec(kind="bulan", start="1998-02-10", end="1998-11-03")
    return _rows(filters.apply_filters(billing(spark, sf_dir), spec))


@query("filter_year", with_billing(f"""
SELECT {ROW_VIEW_SQL} FROM billing WHERE tahun BETWEEN 1999 AND 2000"""))
def q_filter_year(spark, sf_dir):
    spec = filters.FilterSpec(kind="tahun", start="1999-06-01", end="2000-01-31")
    return _rows(filters.apply_filters(billing(spark, sf_dir), spec))


@query("filter_combined", with_billing(f"""
SELECT {ROW_VIEW_SQL} FROM billing
WHERE tanggal BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'
  AND poli = 'Brand#19' AND jenis_jaminan = 'NATION_3'"""))
def q_filter_combined(spark, sf_dir):
    spec = filters.FilterSpec(kind="tanggal", start="1996-01-01", end="1999-12-31",
                              clinic="Brand#19", doctor=ALL_DOCTORS, payer="NATION_3")
    return _rows(filters.apply_filters(billing(spark, sf_dir), spec))


@query("filter_stats", with_billing(f"""
SELECT n_rows, mean, total, format('{{:,}}', n_rows) AS n_rows_text,
       format('Rp {{:,.0f}}', mean) AS mean_text,
       format('Rp {{:,.0f}}', total) AS total_text
FROM (SELECT count(*) AS n_rows, {MEAN} AS mean, CAST(sum(biaya) AS DOUBLE) AS total
      FROM billing WHERE tahun BETWEEN 1997 AND 1998 AND dokter = 'Supplier#000000007')"""))
def q_filter_stats(spark, sf_dir):
    spec = filters.FilterSpec(kind="tahun", start="1997-01-01", end="1998-12-31",
                              doctor="Supplier#000000007")
    return marts.filter_stats(filters.apply_filters(billing(spark, sf_dir), spec))


@query("filter_range_fallback", with_billing("""
SELECT bulan_tahun, count(*) AS n_rows FROM billing GROUP BY bulan_tahun"""))
def q_filter_range_fallback(spark, sf_dir):
    # Months chosen in reverse order: start > end, so the full range applies.
    bounds = filters.month_selection_range(["August 1997", "February 1996"])
    spec = filters.selection_spec("bulan", bounds)
    return (filters.apply_filters(lines(spark, sf_dir), spec)
            .groupBy(C.month_key).agg(F.count(F.lit(1)).alias("n_rows")))


@query("filter_month_selection", with_billing("""
SELECT bulan_tahun, count(*) AS n_rows FROM billing
WHERE bulan_tahun BETWEEN '1996-02' AND '1997-03' GROUP BY bulan_tahun"""))
def q_filter_month_selection(spark, sf_dir):
    # The first and last month *in selection order* are the ends.
    bounds = filters.month_selection_range(["February 1996", "May 1996", "March 1997"])
    spec = filters.selection_spec("bulan", bounds)
    return (filters.apply_filters(lines(spark, sf_dir), spec)
            .groupBy(C.month_key).agg(F.count(F.lit(1)).alias("n_rows")))


@query("filter_year_selection", with_billing("""
SELECT tahun, count(*) AS n_rows FROM billing
WHERE tahun BETWEEN 1996 AND 1999 GROUP BY tahun"""))
def q_filter_year_selection(spark, sf_dir):
    """F8 for years: the first and last year in selection order are the ends."""
    bounds = filters.year_selection_range(["1996", "1998", "1999"])
    spec = filters.selection_spec("tahun", bounds)
    return (filters.apply_filters(lines(spark, sf_dir), spec)
            .groupBy(C.year).agg(F.count(F.lit(1)).alias("n_rows")))


@query("filter_default_months", with_billing("""
SELECT bulan_tahun, count(*) AS n_rows FROM billing
WHERE bulan_tahun <= (SELECT max(bulan_tahun) FROM (
  SELECT DISTINCT bulan_tahun FROM billing ORDER BY bulan_tahun LIMIT 2)) GROUP BY bulan_tahun"""))
def q_filter_default_months(spark, sf_dir):
    """F8: the default month selection, the first two month options."""
    rows = lines(spark, sf_dir)
    labels = [r["label"] for r in options.month_options(rows).orderBy(C.month_key).limit(2).collect()]
    spec = filters.selection_spec("bulan", filters.month_selection_range(labels))
    return (filters.apply_filters(rows, spec)
            .groupBy(C.month_key).agg(F.count(F.lit(1)).alias("n_rows")))


@query("filter_top_clinics", with_billing(f"""
SELECT {ROW_VIEW_SQL} FROM billing WHERE poli IN (
  SELECT poli FROM billing WHERE poli IS NOT NULL GROUP BY poli
  ORDER BY count(*) DESC, poli LIMIT 10)"""))
def q_filter_top_clinics(spark, sf_dir):
    """the rows of the ten clinics with the most rows."""
    return _rows(filters.keep_top_keys(billing(spark, sf_dir), C.clinic, 10))


# ----------------------------------------------------------------- O1 – O5
@query("date_bounds", with_billing("""
SELECT coalesce(min(tanggal), DATE '2025-01-01') AS min_date,
       coalesce(max(tanggal), DATE '2025-11-30') AS max_date FROM billing"""))
def q_date_bounds(spark, sf_dir):
    return options.date_bounds(lines(spark, sf_dir))


@query("month_options", with_billing("""
SELECT DISTINCT bulan_tahun,
       strftime(strptime(bulan_tahun || '-01', '%Y-%m-%d'), '%B %Y') AS label FROM billing"""))
def q_month_options(spark, sf_dir):
    return options.month_options(lines(spark, sf_dir))


@query("year_options", with_billing("""
SELECT DISTINCT CAST(tahun AS VARCHAR) AS year FROM billing"""))
def q_year_options(spark, sf_dir):
    return options.year_options(lines(spark, sf_dir))


@query("value_options", with_billing(f"""
SELECT '{ALL_DOCTORS}' AS option, true AS is_all
UNION ALL
SELECT DISTINCT dokter AS option, false AS is_all FROM billing WHERE dokter IS NOT NULL"""))
def q_value_options(spark, sf_dir):
    return options.value_options(billing(spark, sf_dir), C.doctor, ALL_DOCTORS)


def _options_sql(column: str, all_label: str) -> str:
    return with_billing(f"""
SELECT '{all_label}' AS option, true AS is_all
UNION ALL
SELECT DISTINCT {column} AS option, false AS is_all FROM billing WHERE {column} IS NOT NULL""")


@query("clinic_options", _options_sql("poli", ALL_CLINICS))
def q_clinic_options(spark, sf_dir):
    return options.value_options(billing(spark, sf_dir), C.clinic, ALL_CLINICS)


@query("payer_options", _options_sql("jenis_jaminan", ALL_PAYERS))
def q_payer_options(spark, sf_dir):
    return options.value_options(billing(spark, sf_dir), C.payer, ALL_PAYERS)


@query("month_label_parse", with_billing("""
SELECT DISTINCT bulan_tahun,
       strftime(strptime(bulan_tahun || '-01', '%Y-%m-%d'), '%B %Y') AS label,
       CAST(bulan_tahun || '-01' AS DATE) AS first_day FROM billing"""))
def q_month_label_parse(spark, sf_dir):
    return options.month_options(lines(spark, sf_dir)).withColumn(
        "first_day", options.month_label_to_date("label"))


# ----------------------------------------------------------------- X1 – X3
@query("format_rupiah", with_billing("""
SELECT id_transaksi, CAST(biaya AS DOUBLE) AS biaya,
       format('Rp {:,.0f}', CAST(biaya AS DOUBLE)) AS biaya_text FROM billing"""))
def q_format_rupiah(spark, sf_dir):
    b = lines(spark, sf_dir)
    return b.select(C.transaction, F.col(C.cost).cast("double").alias("biaya"),
                    textfmt.rupiah(C.cost).alias("biaya_text"))


@query("format_compact", with_billing(f"""
SELECT nama_pasien, total_cost, {_compact_sql('total_cost')} AS total_label
FROM (SELECT nama_pasien, CAST(sum(biaya) AS DOUBLE) AS total_cost FROM billing
      WHERE nama_pasien IS NOT NULL GROUP BY nama_pasien)"""))
def q_format_compact(spark, sf_dir):
    totals = (billing(spark, sf_dir).where(F.col(C.patient).isNotNull()).groupBy(C.patient)
              .agg(F.sum(C.cost).cast("double").alias("total_cost")))
    return totals.withColumn("total_label", textfmt.compact("total_cost"))


@query("truncate_label", with_billing("""
SELECT DISTINCT nama_pasien, poli,
       CASE WHEN length(nama_pasien || ' - ' || poli) > 20
            THEN substr(nama_pasien || ' - ' || poli, 1, 20) || '...'
            ELSE nama_pasien || ' - ' || poli END AS label
FROM billing WHERE nama_pasien IS NOT NULL AND poli IS NOT NULL"""))
def q_truncate_label(spark, sf_dir):
    b = billing(spark, sf_dir).where(F.col(C.patient).isNotNull() & F.col(C.clinic).isNotNull())
    pairs = b.select(C.patient, C.clinic).distinct()
    return pairs.withColumn(
        "label", textfmt.truncate(F.concat_ws(" - ", C.patient, C.clinic), 20))


# ----------------------------------------------------------------- S1 – S8, C1 – C6
# Text rows appended to feed A — a header line read as data
# and edge cases of the time and amount parsers (C2, C3, S6). Those in
# EDGE_CLEAN survive cleaning, the rest are dropped.
EDGE_ROWS_A = [
    ("id_transaksi", "id_pasien", "no_urut", "nama_pasien", "waktu", "dokter", "jenis_layanan",
     "poli", "sumber_pembayaran", "biaya", "diskon", "flag"),
    ("E-1", "P-1", "1", "Edge Patient", "5/1/2025 9:05", "Edge Doctor", "R", "Brand#E",
     "1-URGENT", "1,234,567.89", "0.00", "O"),
    ("E-2", "P-1", "2", "Edge Patient", "05/01/2025  10:00", "Edge Doctor", "R", "Brand#E",
     "1-URGENT", " 5 ", "0.00", "O"),
    ("E-3", "P-2", "1", "Edge Patient Two", "29/02/2024 00:00", "Edge Doctor", "N", "Brand#E",
     "2-HIGH", "1,2,3", "0.00", "O"),
    ("E-4", "P-2", "2", "Edge Patient Two", "31/02/2025 10:00", "Edge Doctor", "N", "Brand#E",
     "2-HIGH", "100", "0.00", "O"),
    ("E-5", "P-2", "3", "Edge Patient Two", "05/01/2025 10:00", "Edge Doctor", "N", "Brand#E",
     "2-HIGH", "abc", "0.00", "O"),
    ("E-6", "P-2", "4", "Edge Patient Two", "05/01/2025 10:00", "Edge Doctor", "N", "Brand#E",
     "2-HIGH", "nan", "0.00", "O"),
    ("E-7", "P-2", "5", "Edge Patient Two", "NA", "Edge Doctor", "N", "Brand#E",
     "2-HIGH", "100", "0.00", "O"),
    ("E-8", "P-2", "6", "Edge Patient Two", "05/01/2025 10:00", "Edge Doctor", "N", "Brand#E",
     "2-HIGH", "5d", "0.00", "O"),
    ("E-9", "P-2", "7", "Edge Patient Two", "2025-01-05 10:00", "Edge Doctor", "N", "Brand#E",
     "2-HIGH", "100", "0.00", "O"),
    ("E-10", "P-2", "8", "Edge Patient Two", "05/01/2025 10:00", "Edge Doctor", "N", "Brand#E",
     "2-HIGH", "inf", "0.00", "O"),
    ("E-11", "P-3", "1", "Edge Patient Three", "7/2/2025 8:30", "Edge Doctor", "N", "Brand#E",
     "2-HIGH", "\t5\t", "0.00", "O"),
    *((f"E-{12 + i}", "P-2", "9", "Edge Patient Two", time, "Edge Doctor", "N", "Brand#E",
       "2-HIGH", "100", "0.00", "O") for i, time in enumerate((
           "005/01/2025 10:00", "05/001/2025 10:00", "5/1/2025 010:005", "0005/1/2025 9:5",
           "5/1/+12025 10:00"))),
]
# Expected typed values of the surviving edge rows: (id, time, amount).
EDGE_CLEAN = [("E-1", "2025-01-05 09:05:00", "1234567.89"),
              ("E-2", "2025-01-05 10:00:00", "5"),
              ("E-3", "2024-02-29 00:00:00", "123"),
              ("E-11", "2025-02-07 08:30:00", "5")]


def _sql_text(v) -> str:
    from costmart.schema import NA_TOKENS
    if v is None or v in NA_TOKENS:
        return "NULL"
    return "'" + str(v).replace("'", "''") + "'"


def _edge_values_raw() -> str:
    rows = []
    for r in EDGE_ROWS_A:
        vals = [_sql_text(v) for v in r] + ["CAST(NULL AS VARCHAR)"]
        rows.append("(" + ", ".join(vals) + ")")
    return ",\n  ".join(rows)


def _edge_clean_rows():
    import datetime as dt
    by_id = {r[0]: r for r in EDGE_ROWS_A}
    out = []
    for tid, ts, amount in EDGE_CLEAN:
        r = by_id[tid]
        t = dt.datetime.fromisoformat(ts)
        out.append(dict(id_transaksi=tid, id_pasien=r[1], nama_pasien=r[3], waktu=ts,
                        biaya=amount, tanggal=t.date().isoformat(), tahun=t.year,
                        bulan=t.month, hari_dlm_minggu=t.weekday(),
                        bulan_tahun=t.strftime("%Y-%m"), minggu=t.isocalendar()[1],
                        poli=r[7], dokter=r[5], sumber_pembayaran=r[8]))
    return out


def _edge_values_clean() -> str:
    rows = []
    for e in _edge_clean_rows():
        rows.append(
            f"('{e['id_transaksi']}', '{e['id_pasien']}', '{e['nama_pasien']}', "
            f"TIMESTAMP '{e['waktu']}', CAST({e['biaya']} AS DOUBLE), DATE '{e['tanggal']}', "
            f"{e['tahun']}, {e['bulan']}, {e['hari_dlm_minggu']}, '{e['bulan_tahun']}', "
            f"{e['minggu']}, '{e['poli']}', '{e['dokter']}', '{e['sumber_pembayaran']}', "
            f"CAST(NULL AS VARCHAR))")
    return ",\n  ".join(rows)


def _feeds(spark: SparkSession, sf_dir: str, feed_b: bool = True) -> tuple[str, str]:
    """Render the tables as the two CSV feeds (plus the edge rows) in a fresh
    folder below the shared checkpoint folder."""
    from costmart.schema import FEED_A_COLUMNS, string_schema
    from costmart.session import shared_dir
    from costmart.sources.derive import write_feeds
    edge = spark.createDataFrame(EDGE_ROWS_A, string_schema(FEED_A_COLUMNS))
    return write_feeds(billing(spark, sf_dir), shared_dir(spark, "feeds"), extra_a=edge,
                       feed_b=feed_b)


def _read_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    from costmart.sources.feeds import feed_a, feed_b, read_feeds
    path_a, path_b = _feeds(spark, sf_dir)
    return read_feeds(spark, [feed_a(path_a), feed_b(path_b)])


RAW_TEXT_SQL = """
SELECT id_transaksi, CAST(id_pasien AS VARCHAR) AS id_pasien, CAST(no_urut AS VARCHAR) AS no_urut,
       nama_pasien, strftime(waktu, '%d/%m/%Y %H:%M') AS waktu, dokter, jenis_layanan, poli,
       CASE WHEN flag = 'F' THEN jenis_jaminan ELSE sumber_pembayaran END AS sumber_pembayaran,
       format('{:,.2f}', CAST(biaya AS DOUBLE)) AS biaya,
       CAST(CAST(diskon AS DECIMAL(4,2)) AS VARCHAR) AS diskon, flag, jenis_jaminan
FROM billing"""


@query("ingest_union", with_billing(f"""
{RAW_TEXT_SQL}
UNION ALL
SELECT * FROM (VALUES
  {_edge_values_raw()}) AS e(id_transaksi, id_pasien, no_urut, nama_pasien, waktu, dokter,
     jenis_layanan, poli, sumber_pembayaran, biaya, diskon, flag, jenis_jaminan)"""))
def q_ingest_union(spark, sf_dir):
    """Both feeds read, renamed, unioned by name, NA words -> NULL."""
    from costmart.schema import CANONICAL
    return _read_unified(spark, sf_dir).select(*CANONICAL)


FEED_ORDER = ["feed", "waktu", "id_transaksi"]


@query("first_k_feed_order", with_billing(
    "SELECT nama_pasien, first_clinics FROM first_clinics",
    "base AS (SELECT *, CASE WHEN flag = 'O' THEN 0 ELSE 1 END AS feed FROM billing"
    " WHERE nama_pasien IS NOT NULL),"
    + _first_k_cte("first_clinics", "nama_pasien", "poli", 3, "base", ", ".join(FEED_ORDER))))
def q_first_k_feed_order(spark, sf_dir):
    """A1 in feed order (D6): feed A's rows come before feed B's, whatever their time."""
    from costmart.operators.clean import clean
    rows = clean(_read_unified(spark, sf_dir)).where(~F.col("id_transaksi").startswith("E-"))
    return aggregates.first_k_distinct(rows, [C.patient], C.clinic, 3,
                                       C.row_order(rows.columns), "first_clinics")


CLEAN_COLS = ["id_transaksi", "id_pasien", "nama_pasien", "waktu", "biaya", "tanggal", "tahun",
              "bulan", "hari_dlm_minggu", "bulan_tahun", "minggu", "poli", "dokter",
              "sumber_pembayaran", "jenis_jaminan"]


@query("clean_rows", with_billing(f"""
SELECT id_transaksi, CAST(id_pasien AS VARCHAR) AS id_pasien, nama_pasien, waktu,
       CAST(biaya AS DOUBLE) AS biaya, tanggal, tahun, bulan, hari_dlm_minggu, bulan_tahun, minggu,
       poli, dokter,
       CASE WHEN flag = 'F' THEN jenis_jaminan ELSE sumber_pembayaran END AS sumber_pembayaran,
       jenis_jaminan
FROM billing
UNION ALL
SELECT * FROM (VALUES
  {_edge_values_clean()}) AS e({", ".join(CLEAN_COLS)})"""))
def q_clean_rows(spark, sf_dir):
    """Header rows dropped, time and amount typed, bad rows dropped."""
    from costmart.operators.clean import clean
    cleaned = clean(_read_unified(spark, sf_dir))
    return cleaned.select(*[F.col(c).cast("double").alias(c) if c == "biaya" else F.col(c)
                            for c in CLEAN_COLS])


@query("row_audit", with_billing(f"""
SELECT CAST(count(*) + {len(EDGE_ROWS_A)} AS BIGINT) AS n_raw,
       CAST(count(*) + {len(EDGE_CLEAN)} AS BIGINT) AS n_clean,
       count(*) FILTER (WHERE tahun BETWEEN 1996 AND 1998 AND poli = 'Brand#19') AS n_filtered
FROM billing"""))
def q_row_audit(spark, sf_dir):
    """Raw, clean and filtered counts in one pass over the raw feeds."""
    from costmart.operators.clean import row_audit
    spec = filters.FilterSpec(kind="tahun", start="1996-01-01", end="1998-12-31", clinic="Brand#19")
    return row_audit(_read_unified(spark, sf_dir), spec)


@query("payer_default", with_billing("""
SELECT id_transaksi, sumber_pembayaran, sumber_pembayaran AS jenis_jaminan
FROM billing WHERE flag = 'O'
UNION ALL
SELECT * FROM (VALUES ('E-1', '1-URGENT', '1-URGENT'), ('E-2', '1-URGENT', '1-URGENT'),
                      ('E-3', '2-HIGH', '2-HIGH'), ('E-11', '2-HIGH', '2-HIGH')) AS e(id_transaksi, sumber_pembayaran, jenis_jaminan)"""))
def q_payer_default(spark, sf_dir):
    """Feed A alone has no payer column; it is filled from the source."""
    from costmart.operators.clean import clean
    from costmart.sources.feeds import feed_a, read_feed
    path_a, _ = _feeds(spark, sf_dir, feed_b=False)
    cleaned = clean(read_feed(spark, feed_a(path_a)))
    return cleaned.select("id_transaksi", "sumber_pembayaran", "jenis_jaminan")


# ----------------------------------------------------------------- S7, S9, S10
@query("materialized_billing", with_billing(f"""
SELECT {ROW_VIEW_SQL} FROM billing
WHERE tanggal BETWEEN DATE '1996-03-15' AND DATE '1997-08-31'"""))
def q_materialized_billing(spark, sf_dir):
    """The cleaned table written once by month; a date filter then reads
    only the matching month folders (PartitionFilters)."""
    from costmart.session import shared_dir
    from costmart.sources.sinks import read_table, write_table
    path = shared_dir(spark, "billing")
    write_table(billing(spark, sf_dir), path)
    spec = filters.FilterSpec(kind="tanggal", start="1996-03-15", end="1997-08-31")
    return _rows(filters.apply_filters(read_table(spark, path), spec))


def _export_roundtrip(spark, df, layout, types, sort_by):
    from costmart.session import shared_dir
    from costmart.sources.sinks import read_csv, write_csv
    path = shared_dir(spark, "export")
    write_csv(df, path, layout, sort_by=sort_by)
    return read_csv(spark, path, layout, types)


@query("export_patient_csv", PATIENT_SUMMARY_SQL)
def q_export_patient_csv(spark, sf_dir):
    """Patient summary written as CSV (sorted by total) and read back."""
    from pyspark.sql import types as T

    from costmart.sources.sinks import PATIENT_EXPORT
    summary = marts.patient_summary(billing(spark, sf_dir), order_by=ORDER_KEY)
    types = {"id_pasien": T.LongType(), "n_visits": T.LongType(),
             "total_cost": T.DoubleType(), "mean_cost": T.DoubleType()}
    return _export_roundtrip(spark, summary, PATIENT_EXPORT, types,
                             [F.desc("Total Biaya"), "Nama Pasien", "ID Pasien"])


@query("export_payer_csv", ORACLE["payer_summary"])
def q_export_payer_csv(spark, sf_dir):
    """Payer summary written as CSV and read back."""
    from pyspark.sql import types as T

    from costmart.sources.sinks import PAYER_EXPORT
    summary = marts.payer_summary(billing(spark, sf_dir))
    types = {"n_rows": T.LongType(), "n_patients": T.LongType(), "total_cost": T.DoubleType(),
             "mean_cost": T.DoubleType(), "min_cost": T.DoubleType(), "max_cost": T.DoubleType()}
    return _export_roundtrip(spark, summary, PAYER_EXPORT, types,
                             [F.desc("Total Biaya"), "Jenis Jaminan"])


# ----------------------------------------------------------------- C7, M1 – M8
def _codes_sql(column: str) -> str:
    return f"""
SELECT '{column}' AS column_name, v AS value,
       CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT coalesce(CAST({column} AS VARCHAR), 'nan') AS v FROM billing)"""


@query("ordinal_codes", with_billing(
    " UNION ALL ".join(_codes_sql(c) for c in ["dokter", "poli", "jenis_layanan"])))
def q_ordinal_codes(spark, sf_dir):
    from costmart.operators.encode import fit_all_codes
    return fit_all_codes(billing(spark, sf_dir), ["dokter", "poli", "jenis_layanan"])


def _coded_billing(spark, sf_dir) -> DataFrame:
    from costmart.operators.encode import encode
    from costmart.schema import ENCODED
    from costmart.sources.fixture import row_key
    b = billing(spark, sf_dir).withColumn("row_key", row_key())
    return encode(b, ENCODED)


FEATURES_SQL_CTE = """
codes AS (""" + " UNION ALL ".join(_codes_sql(c) for c in ["dokter", "poli", "jenis_layanan"]) + """),
coded AS (SELECT b.*, cd.code AS dokter_encoded, cp.code AS poli_encoded,
                 cl.code AS jenis_layanan_encoded
          FROM billing b
          JOIN codes cd ON cd.column_name = 'dokter' AND cd.value = coalesce(b.dokter, 'nan')
          JOIN codes cp ON cp.column_name = 'poli' AND cp.value = coalesce(b.poli, 'nan')
          JOIN codes cl ON cl.column_name = 'jenis_layanan'
                       AND cl.value = coalesce(b.jenis_layanan, 'nan'))"""


@query("feature_table", with_billing("""
SELECT row_key, CAST(bulan AS DOUBLE) AS bulan, CAST(hari_dlm_minggu AS DOUBLE) AS hari_dlm_minggu,
       CAST(hari_dlm_bulan AS DOUBLE) AS hari_dlm_bulan,
       CAST(dokter_encoded AS DOUBLE) AS dokter_encoded, CAST(poli_encoded AS DOUBLE) AS poli_encoded,
       CAST(jenis_layanan_encoded AS DOUBLE) AS jenis_layanan_encoded,
       CAST(biaya AS DOUBLE) AS label
FROM coded""", FEATURES_SQL_CTE))
def q_feature_table(spark, sf_dir):
    from costmart.operators.predict import feature_table
    return feature_table(_coded_billing(spark, sf_dir), keep=["row_key"])


SPLIT_SQL = "(CAST(('0x' || substr(md5('42|' || row_key), 1, 8)) AS BIGINT) % 100) < 80"


@query("train_test_split", with_billing(f"""
SELECT row_key, {SPLIT_SQL} AS is_train FROM billing"""))
def q_train_test_split(spark, sf_dir):
    from costmart.operators.predict import hash_split
    from costmart.sources.fixture import row_key
    b = lines(spark, sf_dir).withColumn("row_key", row_key())
    return hash_split(b, "row_key", seed=42).select("row_key", "is_train")


GROUP_MEAN_CTE = f"""
split AS (SELECT *, {SPLIT_SQL} AS is_train FROM billing),
gm AS (SELECT poli, CAST(sum(biaya) AS DOUBLE) / count(biaya) AS g FROM split
       WHERE is_train GROUP BY poli),
overall AS (SELECT CAST(sum(biaya) AS DOUBLE) / count(biaya) AS o FROM split WHERE is_train),
pred AS (SELECT s.row_key, CAST(s.biaya AS DOUBLE) AS actual, coalesce(gm.g, overall.o) AS prediction
         FROM split s LEFT JOIN gm ON s.poli = gm.poli, overall WHERE NOT s.is_train)"""


def _group_mean_pred(spark, sf_dir) -> DataFrame:
    from costmart.operators.predict import group_mean_predictions, hash_split
    from costmart.sources.fixture import row_key
    b = billing(spark, sf_dir).withColumn("row_key", row_key())
    # Written once: the means, the overall mean and the test rows all read it.
    split = materialise(hash_split(b, "row_key", 42).select("row_key", C.clinic, C.cost, "is_train"),
                        "split")
    return group_mean_predictions(split, C.clinic, keep=["row_key"])


@query("regression_metrics", with_billing("""
SELECT n, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 4) AS r2,
       CASE WHEN r2 > 0.7 THEN 'good' WHEN r2 > 0.5 THEN 'fair' WHEN r2 > 0.3 THEN 'moderate'
            ELSE 'low' END AS quality
FROM (SELECT n, mae, rmse,
             CASE WHEN lo = hi THEN CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END
                  ELSE 1.0 - sse / sst END AS r2
      FROM (SELECT count(*) AS n, avg(abs(actual - prediction)) AS mae,
                   sqrt(avg((actual - prediction) * (actual - prediction))) AS rmse,
                   sum((actual - prediction) * (actual - prediction)) AS sse,
                   sum((actual - mean) * (actual - mean)) AS sst,
                   min(actual) AS lo, max(actual) AS hi
            FROM pred, (SELECT avg(actual) AS mean FROM pred)))""", GROUP_MEAN_CTE))
def q_regression_metrics(spark, sf_dir):
    """M5 + M6 on the group-mean predictor (SQL can compute it)."""
    from costmart.operators.predict import metrics
    return metrics(_group_mean_pred(spark, sf_dir))


@query("sample_pairs", with_billing("""
SELECT actual, prediction, abs(actual - prediction) AS abs_error
FROM pred ORDER BY md5('42|' || row_key) LIMIT 1000""", GROUP_MEAN_CTE))
def q_sample_pairs(spark, sf_dir):
    """M7: a repeatable 1,000-pair sample of (actual, prediction)."""
    from costmart.operators.predict import sample_pairs
    return sample_pairs(_group_mean_pred(spark, sf_dir), "row_key", 1000, 42)


@query("prediction_examples", with_billing("""
SELECT actual, prediction, abs_error, format('Rp {:,.0f}', actual) AS actual_text,
       format('Rp {:,.0f}', prediction) AS prediction_text,
       format('Rp {:,.0f}', abs_error) AS error_text
FROM (SELECT actual, prediction, abs(actual - prediction) AS abs_error
      FROM pred ORDER BY md5('7|' || row_key) LIMIT 10)""", GROUP_MEAN_CTE))
def q_prediction_examples(spark, sf_dir):
    """M7 + X1: ten example predictions with their absolute error, also as text."""
    from costmart.operators.predict import sample_pairs
    ex = sample_pairs(_group_mean_pred(spark, sf_dir), "row_key", 10, seed=7)
    return ex.withColumns({"actual_text": textfmt.rupiah("actual"),
                           "prediction_text": textfmt.rupiah("prediction"),
                           "error_text": textfmt.rupiah("abs_error")})


@query("ideal_line", with_billing("""
SELECT min(least(actual, prediction)) AS lo, max(greatest(actual, prediction)) AS hi
FROM (SELECT actual, prediction FROM pred ORDER BY md5('42|' || row_key) LIMIT 1000)""",
                                  GROUP_MEAN_CTE))
def q_ideal_line(spark, sf_dir):
    """M8: ends of the y = x line over the sample."""
    from costmart.operators.predict import ideal_line, sample_pairs
    return ideal_line(sample_pairs(_group_mean_pred(spark, sf_dir), "row_key", 1000, 42))


def _forest(spark, sf_dir):
    """The feature table and the forest fitted on its training part."""
    from costmart.operators.predict import feature_table, fit_forest, hash_split, require_rows
    coded = hash_split(_coded_billing(spark, sf_dir), "row_key", 42)
    # Written once: the forest makes several passes over its input, scoring
    # reads it again, and the row guard reads it, not the joins below it.
    table = materialise(feature_table(coded, keep=["row_key", "is_train"]), "features")
    require_rows(table)
    return table, fit_forest(table.where("is_train"))


@query("forest_predict", with_billing("""
SELECT row_key, CAST(biaya AS DOUBLE) AS actual, true AS in_training_range, true AS learns
FROM split WHERE NOT is_train""", f"split AS (SELECT *, {SPLIT_SQL} AS is_train FROM billing)"))
def q_forest_predict(spark, sf_dir):
    """M1–M4: the default random forest on the training part, its predictions for
    the test part. SQL has no forest; it checks the test rows and labels, that
    every prediction lies in the range of the training labels (a forest
    averages them), and that the forest fits its training rows more closely than
    their group means do, which no constant predictor does."""
    from costmart.operators.predict import forest_report, predict
    table, model = _forest(spark, sf_dir)
    bounds = table.where("is_train").select(
        F.struct(F.min("label").alias("lo"), F.max("label").alias("hi"))).scalar()
    scored = predict(model, table.where(~F.col("is_train")), keep=["row_key"])
    learns = forest_report(model, table, f"{C.clinic}_encoded").select("learns").scalar()
    return scored.withColumns({"_b": bounds, "learns": learns}).select(
        "row_key", "actual",
        F.col("prediction").between(F.col("_b.lo"), F.col("_b.hi")).alias("in_training_range"),
        "learns")


@query("forest_metrics", with_billing("""
SELECT count(*) AS n, true AS learns, true AS near_baseline, true AS band_fits
FROM split WHERE NOT is_train""", f"split AS (SELECT *, {SPLIT_SQL} AS is_train FROM billing)"))
def q_forest_metrics(spark, sf_dir):
    """M5 + M6 of the forest's own predictions: the test rows, and the report's checks
    against the group-mean predictor that SQL can compute (its costs carry no signal,
    so the test error can be near the baseline's, not below it)."""
    from costmart.operators.predict import forest_report
    table, model = _forest(spark, sf_dir)
    return forest_report(model, table, f"{C.clinic}_encoded").select(
        "n", "learns", "near_baseline", "band_fits")


@query("model_data", with_billing(f"""
SELECT count(*) AS n_total, count(*) FILTER (WHERE {SPLIT_SQL}) AS n_train,
       count(*) FILTER (WHERE NOT {SPLIT_SQL}) AS n_test, 6 AS n_features FROM billing"""))
def q_model_data(spark, sf_dir):
    """The model's data set: rows in all, for training, for testing; features."""
    from costmart.operators.predict import data_counts, hash_split
    from costmart.sources.fixture import row_key
    rows = lines(spark, sf_dir).withColumn("row_key", row_key())
    return data_counts(hash_split(rows, "row_key", 42))


# ----------------------------------------------------------------- streaming ingest
@query("stream_ingest", ORACLE["clean_rows"])
def q_stream_ingest(spark, sf_dir):
    """S1–S7 as a stream: feed files -> clean -> month-partitioned table
    (availableNow trigger), then the table is read back."""
    from costmart.schema import FEED_B_RENAME
    from costmart.session import shared_dir
    from costmart.sources.feeds import feed_a, feed_b
    from costmart.sources.sinks import read_table
    from costmart.streaming.ingest import start_ingest
    path_a, path_b = _feeds(spark, sf_dir)
    base = shared_dir(spark, "stream")
    q = start_ingest(spark, [feed_a(path_a), feed_b(path_b)], f"{base}/table", f"{base}/_checkpoint",
                     header_columns={path_b: list(FEED_B_RENAME)})
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    table = read_table(spark, f"{base}/table")     # its batch folders are a column more
    return table.select(*[F.col(c).cast("double").alias(c) if c == "biaya"
                          else F.col(c).cast("string").alias(c) if c == "bulan_tahun"
                          else F.col(c) for c in CLEAN_COLS])


# ----------------------------------------------------------------- C8 display tables
def _display_oracle(summary_sql: str, layout) -> str:
    money = ("total_cost", "mean_cost", "min_cost", "max_cost")
    cols = ", ".join(
        (f"format('Rp {{:,.0f}}', {c}) AS \"{label}\"" if c in money else f"{c} AS \"{label}\"")
        for c, label in layout)
    head, _, tail = summary_sql.rpartition("\nSELECT ")
    return f"{head}\n, summary AS (SELECT {tail})\nSELECT {cols} FROM summary"


def _patient_display_sql() -> str:
    from costmart.sources.sinks import PATIENT_DISPLAY
    return _display_oracle(PATIENT_SUMMARY_SQL, PATIENT_DISPLAY)


def _payer_display_sql() -> str:
    from costmart.sources.sinks import PAYER_DISPLAY
    return _display_oracle(ORACLE["payer_summary"], PAYER_DISPLAY)


@query("patient_display", _patient_display_sql())
def q_patient_display(spark, sf_dir):
    """C8 + X1: the per-patient table as shown, money as 'Rp 1,234'."""
    from costmart.sources.sinks import PATIENT_DISPLAY, display_table
    summary = marts.patient_summary(billing(spark, sf_dir), order_by=ORDER_KEY)
    # Shown by total, descending: a distributed range sort, done only here.
    ordered = summary.orderBy(F.desc("total_cost"), "nama_pasien", "id_pasien")
    return display_table(ordered, PATIENT_DISPLAY)


@query("payer_display", _payer_display_sql())
def q_payer_display(spark, sf_dir):
    """C8 + X1: the per-payer table as shown."""
    from costmart.sources.sinks import PAYER_DISPLAY, display_table
    return display_table(marts.payer_summary(billing(spark, sf_dir)), PAYER_DISPLAY)


# Queries along an order register themselves in the same dictionaries.
from costmart.plans import eventtime, ordered, tables  # noqa: E402, F401
