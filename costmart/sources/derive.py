"""The star-schema tables rendered in the two feed layouts.

Feed A (comma, no header, twelve positional columns) takes the open lines
(``flag = 'O'``) and has no payer; feed B (semicolon, header, source names)
takes the finished lines. Amounts are written with thousands separators and
times as 'dd/MM/yyyy HH:mm', as the feeds carry them. Both are plain parallel
CSV writes of the ``billing`` view, compressed (a file is one task's work for the
readers in any case).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from costmart.schema import FEED_A_COLUMNS, FEED_B_RENAME
from costmart.session import free_shuffles

#: Compression of the feed files.
CODEC = "gzip"


def _as_feed_text(billing: DataFrame) -> DataFrame:
    return billing.select(
        F.col("id_transaksi"),
        F.col("id_pasien").cast("string").alias("id_pasien"),
        F.col("no_urut").cast("string").alias("no_urut"),
        "nama_pasien",
        F.date_format("waktu", "dd/MM/yyyy HH:mm").alias("waktu"),
        "dokter", "jenis_layanan", "poli", "sumber_pembayaran",
        F.format_number(F.col("biaya"), 2).alias("biaya"),
        F.col("diskon").cast("decimal(4,2)").cast("string").alias("diskon"),
        "flag", "jenis_jaminan",
    )


def feed_a_frame(text: DataFrame) -> DataFrame:
    """Feed A rows from the rendered text (``_as_feed_text``)."""
    return text.where(F.col("flag") == "O").select(*FEED_A_COLUMNS)


def feed_b_frame(text: DataFrame) -> DataFrame:
    """Feed B rows, under the source header names."""
    source_name = {v: k for k, v in FEED_B_RENAME.items()}
    return text.where(F.col("flag") == "F").select(
        *[F.col(c).alias(source_name[c]) for c in FEED_B_RENAME.values()])


def _exact(writer: DataFrameWriter) -> DataFrameWriter:
    """Keep blanks at the ends of a value (Spark's writer trims them by default)."""
    return (writer.option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).option("compression", CODEC))


def write_feeds(billing: DataFrame, base: str, extra_a: DataFrame | None = None,
                feed_b: bool = True) -> tuple[str, str]:
    """Write feed A (plus optional extra text rows, e.g. a header line read as
    data) and feed B (unless left out) below ``base``; return both paths."""
    path_a, path_b = f"{base}/feed_a", f"{base}/feed_b"
    # Each layout is a pass of its own: its flag is looked at in the scan of the lines, so a
    # line is joined and shuffled in one of them only, and no copy of the rows is kept.
    text = _as_feed_text(billing)
    _exact(feed_a_frame(text).write.mode("overwrite")).option("sep", ",").csv(path_a)
    if extra_a is not None:
        (_exact(extra_a.select(*FEED_A_COLUMNS).write.mode("append")).option("sep", ",")
         .csv(path_a))
    free_shuffles(billing.sparkSession)
    if feed_b:
        (_exact(feed_b_frame(text).write.mode("overwrite")).option("sep", ";")
         .option("header", True).csv(path_b))
        free_shuffles(billing.sparkSession)
    return path_a, path_b
