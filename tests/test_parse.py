"""C2 / C3 edge rows (FIXTURES §3)."""
import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from costmart.functions.parse import parse_amount, parse_timestamp

TIMES = [
    ("05/01/2025 10:00", dt.datetime(2025, 1, 5, 10, 0)),
    ("05/01/2025  10:00", dt.datetime(2025, 1, 5, 10, 0)),
    ("5/1/2025 9:05", dt.datetime(2025, 1, 5, 9, 5)),
    ("29/02/2024 00:00", dt.datetime(2024, 2, 29, 0, 0)),
    ("31/02/2025 10:00", None),
    ("1/13/2025 10:00", None),
    ("05/01/2025 24:00", None),
    ("05/01/2025", None),
    ("05/01/2025 10:00:30", None),
    ("05/01/25 10:00", None),
    (" 05/01/2025 10:00", None),
    ("05/01/2025 10:00 ", None),
    ("05-01-2025 10:00", None),
    ("2025-01-05 10:00", None),
    ("005/01/2025 10:00", None),
    ("05/001/2025 10:00", None),
    ("5/1/2025 010:005", None),
    ("0005/1/2025 9:5", None),
    ("5/1/+12025 10:00", None),
    ("05/01/2025 10:00\n", None),
    ("waktu", None),
    (None, None),
]

AMOUNTS = [
    ("1,234.50", Decimal("1234.50")),
    ("1,234,567.89", Decimal("1234567.89")),
    ("1,2,3", Decimal("123")),
    (" 5 ", Decimal("5")),
    ("\t5", Decimal("5")),
    ("5\t\n", Decimal("5")),
    ("-3", Decimal("-3")),
    ("+7", Decimal("7")),
    (".5", Decimal("0.5")),
    ("5.", Decimal("5")),
    ("0", Decimal("0")),
    ("1e3", Decimal("1000")),
    ("abc", None), ("", None), (None, None), ("nan", None),
    ("1.000.000", None), ("1 000", None), ("Rp 5", None),
    ("5d", None), ("5f", None), ("inf", None), ("1e30", None),
]


def test_parse_timestamp(spark):
    df = spark.createDataFrame([(t,) for t, _ in TIMES], "t string")
    got = [r[0] for r in df.select(parse_timestamp(F.col("t"))).collect()]
    assert got == [e for _, e in TIMES]


def test_parse_amount(spark):
    df = spark.createDataFrame([(t,) for t, _ in AMOUNTS], "t string")
    got = [r[0] for r in df.select(parse_amount(F.col("t"))).collect()]
    for (text, want), g in zip(AMOUNTS, got):
        if want is None:
            assert g is None, text
        else:
            assert g == want, text


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_parsers_never_raise(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([("x",), ("99/99/9999 99:99",)], "t string")
        out = df.select(parse_timestamp(F.col("t")).alias("a"), parse_amount(F.col("t")).alias("b"))
        assert all(r.a is None and r.b is None for r in out.collect())
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
