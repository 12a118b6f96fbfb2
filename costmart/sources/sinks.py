"""Sinks: the cleaned table as month-partitioned Parquet (S7), CSV exports of
the summaries (S9, S10). Writers run one task per partition; nothing is
collected to the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costmart.schema import DEFAULT_COLUMNS, Columns

# Export headers of the patient and payer summaries, in order.
PATIENT_EXPORT = [
    ("nama_pasien", "Nama Pasien"),
    ("id_pasien", "ID Pasien"),
    ("n_visits", "Jumlah Kunjungan"),
    ("total_cost", "Total Biaya"),
    ("mean_cost", "Rata-rata Biaya"),
    ("clinics", "Poli"),
    ("doctors", "Dokter"),
    ("main_payer", "Jenis Jaminan Utama"),
]
PAYER_EXPORT = [
    ("jenis_jaminan", "Jenis Jaminan"),
    ("n_rows", "Jumlah Transaksi"),
    ("n_patients", "Jumlah Pasien Unik"),
    ("total_cost", "Total Biaya"),
    ("mean_cost", "Rata-rata Biaya"),
    ("min_cost", "Biaya Min"),
    ("max_cost", "Biaya Max"),
    ("top_clinics", "Top 3 Poli"),
    ("top_doctors", "Top 3 Dokter"),
]


def write_table(df: DataFrame, path: str, cols: Columns = DEFAULT_COLUMNS,
                mode: str = "overwrite", months_only: bool = False) -> None:
    """The cleaned table as Parquet, one folder per month key, so period
    filters prune whole folders (``PartitionFilters``).

    Range partitioning on (month, time, transaction) before the write: the
    bounds come from a sample, so a month holding a third of all rows is split
    over many tasks while small months share one, and each task writes to few
    month folders (no hash repartition by month, which would put a hot month
    into a single task).

    ``months_only``: with mode 'overwrite', replace only the month folders
    present in ``df`` (dynamic partition overwrite), e.g. when one month's
    feed is delivered again; other months stay as they are."""
    writer = (df.repartitionByRange(cols.month_key, cols.time, cols.transaction)
              .write.mode(mode).partitionBy(cols.month_key))
    if months_only:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def read_table(spark: SparkSession, path: str, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """The month-partitioned table; the month key is read back as text
    (folder names like '2025-01' are not left to type inference)."""
    inferred = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType(), True) if f.name == cols.month_key else f
              for f in inferred.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def write_csv(df: DataFrame, path: str, layout: Sequence[tuple[str, str]],
              sort_by: Sequence | None = None, mode: str = "overwrite") -> None:
    """CSV with a header in the fixed column order and labels.

    ``sort_by`` sorts globally (range partitioning); the part files then
    follow that order. Numbers are written unformatted.
    """
    out = df.select(*[F.col(c).alias(label) for c, label in layout])
    if sort_by:
        out = out.orderBy(*sort_by)
    (out.write.mode(mode).option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("quoteAll", False).csv(path))


def read_csv(spark: SparkSession, path: str, layout: Sequence[tuple[str, str]],
             types: dict[str, T.DataType]) -> DataFrame:
    """Read an export back under the canonical names and types (names may hold line breaks)."""
    schema = T.StructType([T.StructField(c, types.get(c, T.StringType()), True)
                           for c, _ in layout])
    return (spark.read.schema(schema).option("header", True).option("escape", '"')
            .option("multiLine", True).csv(path))


# On-screen tables of the summaries (money shown as 'Rp 1,234').
PATIENT_DISPLAY = [
    ("nama_pasien", "Nama Pasien"),
    ("n_visits", "Jumlah Kunjungan"),
    ("total_cost", "Total Biaya"),
    ("mean_cost", "Rata-rata Biaya"),
    ("clinics", "Poli"),
    ("doctors", "Dokter"),
    ("main_payer", "Jenis Jaminan Utama"),
]
PAYER_DISPLAY = [
    ("jenis_jaminan", "Jenis Jaminan"),
    ("n_rows", "Jumlah Transaksi"),
    ("n_patients", "Jumlah Pasien Unik"),
    ("total_cost", "Total Biaya"),
    ("mean_cost", "Rata-rata Biaya"),
    ("min_cost", "Biaya Min"),
    ("max_cost", "Biaya Max"),
    ("top_clinics", "Top 3 Poli"),
    ("top_doctors", "Top 3 Dokter"),
]
MONEY_COLUMNS = ("total_cost", "mean_cost", "min_cost", "max_cost")


def display_table(df: DataFrame, layout: Sequence[tuple[str, str]],
                  money: Sequence[str] = MONEY_COLUMNS) -> DataFrame:
    """Pick and rename columns for display; money as 'Rp 1,234' (X1)."""
    from costmart.functions.textfmt import rupiah
    return df.select(*[(rupiah(c) if c in money else F.col(c)).alias(label)
                       for c, label in layout])
