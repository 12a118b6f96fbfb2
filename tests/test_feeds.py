"""Feeds, cleaning, audit, CSV round trip."""
import os

import pytest
from pyspark.sql import functions as F

from costmart.operators.clean import clean, default_payer, row_audit
from costmart.schema import CANONICAL, FEED_A_COLUMNS, UNKNOWN, string_schema
from costmart.session import shared_dir
from costmart.sources import sinks
from costmart.sources.feeds import feed_a, feed_b, read_feed, read_feeds


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


@pytest.fixture()
def feeds(spark, tmp_path):
    a = tmp_path / "a" / "part-0.csv"
    b = tmp_path / "b" / "part-0.csv"
    _write(str(a), ",".join(FEED_A_COLUMNS) + "\n"
           + "T1,007,1,Ann,05/01/2025 10:00,Dr X,R,Poli A,BPJS,\"1,234.50\",0,0\n"
           + "T2,008,1,Bob,31/02/2025 10:00,Dr X,R,Poli A,BPJS,100,0,0\n"
           + "T3,009,1,NA,5/1/2025 9:05,Dr Y,N,Poli B,Umum,nan,0,0\n"
           + "T4,010,1,\"Doe, Jane\",06/01/2025 11:30,Dr Y,N,Poli B,Umum,250,0,0\n")
    _write(str(b), "NO;RM;EPS;NAMA;ADMISI;DOKTER;JENIS PELAYANAN;RAWAT;PENJAMIN;TOTAL;DISKON;"
           "MENINGGAL\n"
           + "B1;011;1;Cat;07/01/2025 08:00;Dr Z;Poli C;Inap;Asuransi X;2,000;0;0\n"
           + "B2;012;1;Dan;07/01/2025 08:00;Dr Z;Poli C;Inap;NULL;3,000;0;0\n")
    return str(a.parent), str(b.parent)


def test_union_and_clean(spark, feeds):
    pa, pb = feeds
    raw = read_feeds(spark, [feed_a(pa), feed_b(pb)])
    assert raw.columns == [*CANONICAL, "feed"]
    assert {r.id_transaksi[0]: r.feed for r in raw.collect()} == {"i": 0, "T": 0, "B": 1}
    assert raw.count() == 7                      # header row + 4 + 2
    rows = {r.id_transaksi: r for r in raw.collect()}
    assert rows["T1"].id_pasien == "007"         # ids stay text
    assert rows["T3"].nama_pasien is None        # 'NA' -> NULL
    assert rows["T4"].nama_pasien == "Doe, Jane"
    assert rows["B1"].sumber_pembayaran == "Asuransi X" == rows["B1"].jenis_jaminan
    assert rows["B1"].poli == "Poli C" and rows["B1"].jenis_layanan == "Inap"
    assert rows["T1"].jenis_jaminan is None      # feed A has no payer (D4)
    cleaned = {r.id_transaksi: r for r in clean(raw).collect()}
    assert set(cleaned) == {"T1", "T4", "B1", "B2"}
    assert float(cleaned["T1"].biaya) == 1234.5 and float(cleaned["B1"].biaya) == 2000


def test_row_audit(spark, feeds):
    from costmart.operators.filters import FilterSpec
    pa, pb = feeds
    raw = read_feeds(spark, [feed_a(pa), feed_b(pb)])
    r = row_audit(raw, FilterSpec(clinic="Poli C")).first()
    assert (r.n_raw, r.n_clean, r.n_filtered) == (7, 4, 2)


def test_width_check(spark, tmp_path):
    p = tmp_path / "bad" / "x.csv"
    _write(str(p), "a,b,c\n1,2,3\n")
    with pytest.raises(ValueError):
        read_feed(spark, feed_a(str(p.parent)))


def test_payer_default_per_schema(spark):
    df = spark.createDataFrame([("x",), (None,)], "sumber_pembayaran string")
    assert [r.jenis_jaminan for r in default_payer(df).collect()] == ["x", None]
    df2 = spark.createDataFrame([("x",)], "other string")
    assert default_payer(df2).first().jenis_jaminan == UNKNOWN


def test_csv_roundtrip_exact(spark):
    from pyspark.sql import types as T
    layout = [("name", "Nama, Pasien"), ("total", "Total \"Biaya\""), ("txt", "Poli")]
    df = spark.createDataFrame(
        [("a, b", 0.1 + 0.2, 'say "hi"'), ("c", 1e-7, "x,y"), ("d", 123456789.125, "")],
        "name string, total double, txt string")
    path = shared_dir(spark, "test-export")
    sinks.write_csv(df, path, layout, sort_by=[F.desc("Total \"Biaya\"")])
    back = sinks.read_csv(spark, path, layout, {"total": T.DoubleType()})
    got = sorted((r.name, r.total, r.txt or "") for r in back.collect())
    assert got == sorted((r.name, r.total, r.txt) for r in df.collect())


def test_feed_landing_schema_is_text():
    s = string_schema(FEED_A_COLUMNS)
    assert all(f.dataType.simpleString() == "string" for f in s.fields)


def _line(i, *more):
    return f"{i},1,1,Ann,05/01/2025 10:00,Dr X,R,Poli A,BPJS,5,0,0" + "".join(f",{m}" for m in more)


def test_surplus_fields_raise_or_are_marked(spark, tmp_path):
    import dataclasses

    from costmart.sources.feeds import unify
    folder = str(tmp_path / "a")
    _write(f"{folder}/x.csv", "\n".join([
        _line("A"), _line("B", "late"), _line("C").replace("Ann", "Doe, J"),
        _line("D").replace("Ann", '"Doe, J"'), "E,1,1,Short"]) + "\n")
    with pytest.raises(Exception, match="more than 12 fields"):
        read_feeds(spark, [feed_a(folder)]).count()
    marking = dataclasses.replace(feed_a(folder), malformed="mark")
    raw = unify([read_feed(spark, marking)])
    assert {r.id_transaksi: r.malformed for r in raw.collect()} == \
        {"A": False, "B": True, "C": True, "D": False, "E": True}
    audit = row_audit(raw).first()
    assert (audit.n_raw, audit.n_malformed) == (5, 3)
    assert [r.biaya for r in raw.where("id_transaksi = 'E'").collect()] == [None]


def test_reordered_header_raises(spark, feeds):
    _, pb = feeds
    _write(f"{pb}/part-1.csv", "NO;RM;EPS;NAMA;ADMISI;RAWAT;JENIS PELAYANAN;DOKTER;PENJAMIN;TOTAL;"
           "DISKON;MENINGGAL\nB3;1;1;Cat;07/01/2025 08:00;Inap;Poli C;Dr Z;X;2;0;0\n")
    with pytest.raises(Exception):
        read_feed(spark, feed_b(pb)).collect()


def test_export_keeps_blanks_and_line_breaks(spark):
    layout = [("name", "Nama"), ("txt", "Poli")]
    df = spark.createDataFrame([("  Ann ", "a\nb"), ("x\t", "c\r\nd, e")], "name string, txt string")
    path = shared_dir(spark, "test-export")
    sinks.write_csv(df, path, layout)
    back = sinks.read_csv(spark, path, layout, {})
    assert [r.name for r in back.orderBy("name").collect()] == ["  Ann ", "x\t"]
    assert back.where("name = '  Ann '").first().txt == "a\nb"


def test_first_k_follows_the_feeds(spark, tmp_path):
    from costmart.operators.aggregates import first_k_distinct
    from costmart.schema import DEFAULT_COLUMNS
    a, b = str(tmp_path / "fa"), str(tmp_path / "fb")
    _write(f"{a}/x.csv", _line("A").replace("Poli A", "ClinicA").replace("05/01", "25/01") + "\n")
    _write(f"{b}/x.csv", "NO;RM;EPS;NAMA;ADMISI;DOKTER;JENIS PELAYANAN;RAWAT;PENJAMIN;TOTAL;DISKON;"
           "MENINGGAL\nB;1;1;Ann;01/01/2025 08:00;Dr Z;ClinicB;Inap;X;2;0;0\n")
    rows = clean(read_feeds(spark, [feed_a(a), feed_b(b)]))
    got = first_k_distinct(rows, ["nama_pasien"], "poli", 3,
                           DEFAULT_COLUMNS.row_order(rows.columns), "clinics").first()
    assert got.clinics == "ClinicA, ClinicB"
    assert DEFAULT_COLUMNS.row_order(["waktu", "id_transaksi"]) == ["waktu", "id_transaksi"]


def test_clear_shared_removes_own_folders(spark):
    from costmart.session import clear_shared, materialise
    kept = materialise(spark.range(5), "to-clear")
    folder = kept.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert kept.count() == 5 and os.path.isdir(folder)
    clear_shared(spark)
    assert not os.path.exists(folder)


B_HEADER = "NO;RM;EPS;NAMA;ADMISI;DOKTER;JENIS PELAYANAN;RAWAT;PENJAMIN;TOTAL;DISKON;MENINGGAL\n"


def _broken_feeds(tmp_path):
    """Both feeds with a line break, the separator and doubled quotes in a quoted name."""
    a, b = str(tmp_path / "la"), str(tmp_path / "lb")
    _write(f"{a}/x.csv", _line("A").replace("Ann", '"Ann\nLee, ""x"""') + "\n" + _line("B") + "\n")
    _write(f"{b}/x.csv", B_HEADER + 'C;1;1;"Cat\r\nMay; y";07/01/2025 08:00;Dr Z;P;Inap;X;2;0;0\r\n'
           + "D;1;1;Dan;07/01/2025 08:00;Dr Z;P;Inap;X;3;0;0\r\n")
    return a, b


def test_quoted_line_breaks_keep_their_record(spark, tmp_path):
    a, b = _broken_feeds(tmp_path)
    raw = read_feeds(spark, [feed_a(a), feed_b(b)])
    names = {r.id_transaksi: r.nama_pasien for r in raw.collect()}
    assert names == {"A": 'Ann\nLee, "x"', "B": "Ann", "C": "Cat\r\nMay; y", "D": "Dan"}
    assert {r.id_transaksi for r in clean(raw).collect()} == set("ABCD")
    audit = row_audit(raw).first()
    assert (audit.n_raw, audit.n_clean) == (4, 4)


def test_quoted_line_breaks_in_the_stream(spark, tmp_path):
    from costmart.schema import FEED_B_RENAME
    from costmart.streaming.ingest import start_ingest
    a, b = _broken_feeds(tmp_path)
    base = shared_dir(spark, "test-lines")
    query = start_ingest(spark, [feed_a(a), feed_b(b)], f"{base}/t", f"{base}/c",
                         header_columns={b: list(FEED_B_RENAME)})
    query.awaitTermination()
    rows = sinks.read_table(spark, f"{base}/t").collect()
    assert {r.id_transaksi: r.nama_pasien for r in rows}["C"] == "Cat\r\nMay; y" and len(rows) == 4


def test_split_files_raise_on_or_mark_broken_records(spark, tmp_path):
    import dataclasses

    from costmart.sources.feeds import unify
    a = str(tmp_path / "ls")
    _write(f"{a}/x.csv", "\n".join([_line("B"), _line("A").replace("Ann", '"Ann\nLee"')]) + "\n")
    split = dataclasses.replace(feed_a(a), multi_line=False)
    with pytest.raises(Exception, match="open quote"):
        read_feeds(spark, [split]).collect()
    raw = unify([read_feed(spark, dataclasses.replace(split, malformed="mark"))])
    marks = sorted((r.id_transaksi, r.malformed) for r in raw.collect())
    assert marks[0] == ("A", True) and ("B", False) in marks and len(marks) == 3
    assert sum(m for _, m in marks) == 2


def test_clean_parses_each_text_once(spark, feeds):
    rows = clean(read_feeds(spark, [feed_a(feeds[0]), feed_b(feeds[1])]))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    times = [line for line in plan.splitlines() if "gettimestamp" in line]
    assert [line.count("gettimestamp") for line in times] == [1]
    assert not any("Filter" in line or "atleastnnonnulls" in line for line in times)
