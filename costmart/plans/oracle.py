"""DuckDB SQL for the ``billing`` view; each oracle query starts with it.

The driver registers the star-schema tables as views; this CTE builds the
same canonical rows as ``sources.fixture.billing`` (including calendar parts).
Casts follow the output conventions: counts bigint, calendar parts int, money
double at the output, sums as decimals before that.
"""

BILLING_CTE = """
WITH billing AS (
  SELECT
    CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS id_transaksi,
    o.o_custkey AS id_pasien,
    l.l_linenumber AS no_urut,
    c.c_name AS nama_pasien,
    l.l_shipdate AS waktu,
    s.s_name AS dokter,
    l.l_returnflag AS jenis_layanan,
    p.p_brand AS poli,
    o.o_orderpriority AS sumber_pembayaran,
    CASE WHEN l.l_linestatus = 'F' THEN n.n_name END AS jenis_jaminan,
    CAST(l.l_extendedprice AS DECIMAL(18,2)) AS biaya,
    l.l_discount AS diskon,
    l.l_linestatus AS flag,
    l.l_shipdate, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice,
    strftime(l.l_shipdate, '%Y-%m-%d') || '|' || CAST(l.l_orderkey AS VARCHAR) || '|'
      || CAST(l.l_linenumber AS VARCHAR) || '|' || CAST(l.l_partkey AS VARCHAR) || '|'
      || CAST(l.l_suppkey AS VARCHAR) || '|'
      || CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS row_key,
    CAST(l.l_shipdate AS DATE) AS tanggal,
    CAST(year(l.l_shipdate) AS INTEGER) AS tahun,
    CAST(month(l.l_shipdate) AS INTEGER) AS bulan,
    CAST(day(l.l_shipdate) AS INTEGER) AS hari,
    CAST(isodow(l.l_shipdate) - 1 AS INTEGER) AS hari_dlm_minggu,
    CAST(day(l.l_shipdate) AS INTEGER) AS hari_dlm_bulan,
    strftime(l.l_shipdate, '%Y-%m') AS bulan_tahun,
    CAST(week(l.l_shipdate) AS INTEGER) AS minggu
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
)
"""


def with_billing(sql: str, extra_ctes: str = "") -> str:
    """Prefix a query over ``billing`` (and optional further CTEs) with the view."""
    head = BILLING_CTE.rstrip()
    if extra_ctes:
        head += ",\n" + extra_ctes.strip()
    return head + "\n" + sql.strip()
