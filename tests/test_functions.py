"""Calendar parts and display formats."""
import datetime as dt

from pyspark.sql import functions as F

from costmart.functions import textfmt
from costmart.functions.calendar import with_calendar


def test_week_and_weekday(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 12, 30),), (dt.datetime(2025, 1, 1),), (dt.datetime(2027, 1, 1),),
         (dt.datetime(2025, 1, 5, 9, 5),)], "waktu timestamp_ntz")
    rows = with_calendar(df).collect()
    assert [r.minggu for r in rows] == [1, 1, 53, 1]
    assert rows[3].hari_dlm_minggu == 6          # Sunday, Monday = 0
    assert rows[3].bulan_tahun == "2025-01"
    assert rows[3].tanggal == dt.date(2025, 1, 5)
    assert (rows[3].tahun, rows[3].bulan, rows[3].hari, rows[3].hari_dlm_bulan) == (2025, 1, 5, 5)


def test_rupiah_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-1234.5,), (1234567.5,)], "x double")
    got = [r[0] for r in df.select(textfmt.rupiah("x")).collect()]
    assert got == ["Rp 0", "Rp 2", "Rp 2", "Rp -1,234", "Rp 1,234,568"]


def test_compact(spark):
    df = spark.createDataFrame([(999.0,), (1500.0,), (2500.0,), (1e6,), (1250000.0,),
                                (1234567890.0,)], "x double")
    got = [r[0] for r in df.select(textfmt.compact("x")).collect()]
    assert got == ["Rp 1K", "Rp 2K", "Rp 2K", "Rp 1.0M", "Rp 1.2M", "Rp 1,234.6M"]


def test_truncate_and_labels(spark):
    df = spark.createDataFrame([("a" * 20,), ("b" * 21,), ("2025-01",)], "s string")
    got = [r[0] for r in df.select(textfmt.truncate("s", 20)).collect()]
    assert got == ["a" * 20, "b" * 20 + "...", "2025-01"]
    lab = df.where("s = '2025-01'").select(textfmt.month_label("s").alias("a"),
                                           textfmt.month_label("s", long=True).alias("b")).first()
    assert (lab.a, lab.b) == ("Jan 2025", "January 2025")
    n = spark.range(1).select(textfmt.count_text(F.lit(1234567)).alias("n")).first().n
    assert n == "1,234,567"


def test_scale_conf_sizes_partitions():
    from costmart.session import scale_conf
    small = scale_conf(1 << 30, 8)
    big = scale_conf(100 << 40, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 24
    assert int(big["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    assert big["spark.sql.adaptive.enabled"] == "true"
