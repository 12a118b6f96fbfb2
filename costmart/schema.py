"""Canonical column names, feed layouts and fixed values.

Column names are parameters of every operator (``Columns``); the defaults are
the canonical transaction layout of the hospital feeds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Columns:
    """Names of the canonical transaction columns."""

    transaction: str = "id_transaksi"
    patient_id: str = "id_pasien"
    line_no: str = "no_urut"
    patient: str = "nama_pasien"
    time: str = "waktu"
    doctor: str = "dokter"
    service: str = "jenis_layanan"
    clinic: str = "poli"
    source: str = "sumber_pembayaran"
    cost: str = "biaya"
    discount: str = "diskon"
    flag: str = "flag"
    payer: str = "jenis_jaminan"
    # derived calendar columns
    date: str = "tanggal"
    year: str = "tahun"
    month: str = "bulan"
    day: str = "hari"
    weekday: str = "hari_dlm_minggu"
    day_of_month: str = "hari_dlm_bulan"
    month_key: str = "bulan_tahun"
    week: str = "minggu"
    # place of the row's feed among the feeds (added by ``sources.feeds.unify``)
    feed: str = "feed"
    # columns that fix the row order for "first k distinct" (decision D6); a
    # table without feeds leaves out the first
    order_by: tuple[str, ...] = field(default=("feed", "waktu", "id_transaksi"))

    def row_order(self, columns: list[str]) -> list[str]:
        """The order columns that a table with ``columns`` has."""
        return [c for c in self.order_by if c in columns]


DEFAULT_COLUMNS = Columns()

# ---------------------------------------------------------------------------
# Fixed values. These must equal the source application's for equal results.
# ---------------------------------------------------------------------------

# Feed A: comma separated, no header, twelve columns by position.
FEED_A_COLUMNS = [
    "id_transaksi", "id_pasien", "no_urut", "nama_pasien", "waktu",
    "dokter", "jenis_layanan", "poli", "sumber_pembayaran", "biaya",
    "diskon", "flag",
]

# Feed B: semicolon separated, with header; source name -> canonical name.
FEED_B_RENAME = {
    "NO": "id_transaksi",
    "RM": "id_pasien",
    "EPS": "no_urut",
    "NAMA": "nama_pasien",
    "ADMISI": "waktu",
    "DOKTER": "dokter",
    "JENIS PELAYANAN": "poli",
    "RAWAT": "jenis_layanan",
    "PENJAMIN": "jenis_jaminan",
    "TOTAL": "biaya",
    "DISKON": "diskon",
    "MENINGGAL": "flag",
}

# Canonical row after the union of both feeds: feed A's columns + the payer.
CANONICAL = FEED_A_COLUMNS + ["jenis_jaminan"]

# Text read as missing (the default NA tokens of the pandas CSV reader).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Time format of the feeds, as strftime '%d/%m/%Y %H:%M'.
FEED_TIME_FORMAT = "d/M/yyyy H:m"

UNKNOWN = "Tidak Diketahui"      # "unknown"
OTHER = "Lainnya"                # "other"
ALL_CLINICS = "Semua Poli"       # "all clinics" = no filter
ALL_DOCTORS = "Semua Dokter"     # "all doctors" = no filter
ALL_PAYERS = "Semua Jaminan"     # "all payers" = no filter
DEFAULT_MIN_DATE = "2025-01-01"  # date bounds when the table is empty
DEFAULT_MAX_DATE = "2025-11-30"

# Sizes used by the dashboard.
TOP_N = 10
SHARE_TOP_N = 8
TOP_PATIENTS = 20
HISTOGRAM_BINS = 50
FIRST_CLINICS = 3
FIRST_DOCTORS = 2
TOP_PER_PAYER = 3
MIN_MODEL_ROWS = 100
SAMPLE_POINTS = 1000
FEATURES = [
    "bulan", "hari_dlm_minggu", "hari_dlm_bulan",
    "dokter_encoded", "poli_encoded", "jenis_layanan_encoded",
]
ENCODED = ["dokter", "poli", "jenis_layanan"]


def string_schema(names: list[str]) -> T.StructType:
    """All-text landing schema: nothing is inferred (ids stay text)."""
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])
