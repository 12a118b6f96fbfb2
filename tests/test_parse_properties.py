"""C2 / C3 against pandas' own parsers on generated text.

The source application parses times with ``pd.to_datetime(format='%d/%m/%Y
%H:%M', errors='coerce')`` and amounts with ``pd.to_numeric(errors='coerce')``
after removing commas. Generated strings are parsed by both; where pandas
gives a value, ours must equal it (amounts: to the cent, half-up), and where
pandas gives NaT/NaN ours must be NULL. The documented exceptions (decision
D8: inf and amounts beyond decimal(18,2)) are excluded from the comparison.
"""
import math
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from costmart.functions.parse import parse_amount, parse_timestamp

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.too_slow, HealthCheck.data_too_large])


def _num(lo, hi, pad):
    return st.builds(lambda v, p: str(v).zfill(2) if p else str(v), st.integers(lo, hi), pad)


time_text = st.builds(
    lambda d, m, y, h, mi, sep: f"{d}/{m}/{y}{sep}{h}:{mi}",
    _num(0, 33, st.booleans()), _num(0, 13, st.booleans()), st.integers(1900, 2100).map(str),
    _num(0, 25, st.booleans()), _num(0, 61, st.booleans()), st.sampled_from([" ", "  ", "   "]))

amount_text = st.one_of(
    st.text(alphabet="0123456789,.-+e ", max_size=12),
    st.builds(lambda a, b: f"{a:,}.{b:02d}", st.integers(0, 10**12), st.integers(0, 99)),
)


@SETTINGS
@given(st.lists(time_text, min_size=40, max_size=120))
def test_time_parser_matches_pandas(spark, texts):
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string")
           .select(parse_timestamp(F.col("t"))).collect()]
    want = pd.to_datetime(pd.Series(texts), format="%d/%m/%Y %H:%M", errors="coerce")
    for t, g, w in zip(texts, got, want):
        if pd.isna(w):
            assert g is None, t
        else:
            assert g == w.to_pydatetime(), t


@SETTINGS
@given(st.lists(amount_text, min_size=40, max_size=120))
def test_amount_parser_matches_pandas(spark, texts):
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string")
           .select(parse_amount(F.col("t"))).collect()]
    cleaned = pd.Series(texts).astype(str).str.replace(",", "", regex=False)
    want = pd.to_numeric(cleaned, errors="coerce")
    for t, c, g, w in zip(texts, cleaned, got, want):
        if pd.isna(w):
            assert g is None, t
        elif math.isinf(w) or abs(w) >= 1e16:
            continue                                  # D8: inf / overflow -> NULL
        else:
            exact = Decimal(c.strip()).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
            assert g == exact, t
            assert abs(float(g) - w) <= 0.005 + 1e-9 * abs(w), t


money = st.one_of(
    st.floats(min_value=-1e12, max_value=1e12, allow_nan=False, allow_infinity=False),
    st.integers(-10**9, 10**9).map(lambda i: i / 2),          # exact halves: tie rounding
    st.integers(0, 10**11).map(lambda i: i / 100),            # cents
)


@SETTINGS
@given(st.lists(money, min_size=40, max_size=120))
def test_money_text_matches_python_format(spark, xs):
    from costmart.functions.textfmt import compact, rupiah
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select(
        rupiah("x").alias("r"), compact("x").alias("c")).collect()
    for x, r in zip(xs, rows):
        assert r.r == f"Rp {x:,.0f}", x
        want = f"Rp {x / 1e6:,.1f}M" if x >= 1e6 else f"Rp {x / 1e3:,.0f}K"
        assert r.c == want, x


stamps = st.datetimes(min_value=pd.Timestamp("1990-01-01").to_pydatetime(),
                      max_value=pd.Timestamp("2035-12-31").to_pydatetime())


@SETTINGS
@given(st.lists(stamps, min_size=40, max_size=120))
def test_calendar_parts_match_pandas(spark, ts):
    from costmart.functions.calendar import with_calendar
    ts = [t.replace(microsecond=0) for t in ts]
    got = with_calendar(spark.createDataFrame([(t,) for t in ts], "waktu timestamp_ntz")).collect()
    s = pd.Series(pd.to_datetime(ts))
    want = pd.DataFrame({
        "tanggal": s.dt.date, "tahun": s.dt.year, "bulan": s.dt.month, "hari": s.dt.day,
        "hari_dlm_minggu": s.dt.dayofweek, "bulan_tahun": s.dt.to_period("M").astype(str),
        "minggu": s.dt.isocalendar().week.astype(int)})
    for g, (_, w) in zip(got, want.iterrows()):
        assert (g.tanggal, g.tahun, g.bulan, g.hari, g.hari_dlm_minggu, g.bulan_tahun, g.minggu) == (
            w.tanggal, w.tahun, w.bulan, w.hari, w.hari_dlm_minggu, w.bulan_tahun, w.minggu)
