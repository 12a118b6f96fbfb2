"""Filters (F0–F8): one Column predicate per dashboard selection.

Every predicate is a plain Column, so Catalyst pushes it into the Parquet scan.
Each period filter is stated on both time forms: the month key (on a table
partitioned by ``bulan_tahun`` that bound becomes a ``PartitionFilters``
entry) and the date (which Catalyst pushes to the scan of the time column as a
range). Catalyst derives neither from the other on its own.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costmart.schema import ALL_CLINICS, ALL_DOCTORS, ALL_PAYERS, DEFAULT_COLUMNS, Columns

DateLike = dt.date | str


def _as_date(d: DateLike) -> dt.date:
    if isinstance(d, dt.datetime):
        return d.date()
    if isinstance(d, dt.date):
        return d
    return dt.date.fromisoformat(str(d)[:10])


@dataclass(frozen=True)
class FilterSpec:
    """A dashboard selection. ``kind``: 'tanggal' (date), 'bulan' (month),
    'tahun' (year) or None; None / '' / 'Semua …' switch a category off."""

    kind: str | None = None
    start: DateLike | None = None
    end: DateLike | None = None
    clinic: str | None = None
    doctor: str | None = None
    payer: str | None = None


def date_range(start: DateLike, end: DateLike, cols: Columns = DEFAULT_COLUMNS) -> Column:
    """inclusive date range, plus the month-key bound for pruning."""
    a, b = _as_date(start), _as_date(end)
    return (F.col(cols.date).between(F.lit(a), F.lit(b))
            & month_range(a, b, cols))


def _month_end(d: dt.date) -> dt.date:
    first_next = dt.date(d.year + (d.month == 12), d.month % 12 + 1, 1)
    return first_next - dt.timedelta(days=1)


def month_range(start: DateLike, end: DateLike, cols: Columns = DEFAULT_COLUMNS,
                with_date: bool = False) -> Column:
    """inclusive month range on the 'yyyy-MM' key (text order = time order).

    ``with_date`` adds the same range as a date bound (first day of the first
    month .. last day of the last); a bound on the date reaches the Parquet
    scan of the time column, a bound on formatted text does not."""
    a, b = _as_date(start), _as_date(end)
    pred = F.col(cols.month_key).between(a.strftime("%Y-%m"), b.strftime("%Y-%m"))
    if with_date:
        pred = pred & F.col(cols.date).between(F.lit(a.replace(day=1)), F.lit(_month_end(b)))
    return pred


def year_range(start: DateLike, end: DateLike, cols: Columns = DEFAULT_COLUMNS,
               with_date: bool = False) -> Column:
    """inclusive year range, plus the month-key bound for pruning and,
    with ``with_date``, the date bound for scan pushdown."""
    a, b = _as_date(start).year, _as_date(end).year
    pred = (F.col(cols.year).between(a, b)
            & F.col(cols.month_key).between(f"{a:04d}-01", f"{b:04d}-12"))
    if with_date:
        pred = pred & F.col(cols.date).between(F.lit(dt.date(a, 1, 1)), F.lit(dt.date(b, 12, 31)))
    return pred


def _is_on(choice: str | None, all_label: str) -> bool:
    return bool(choice) and choice != all_label


def category_predicates(spec: FilterSpec, columns: Sequence[str],
                        cols: Columns = DEFAULT_COLUMNS) -> list[Column]:
    """Equality on clinic, doctor, payer; the payer test is skipped when
    the table has no payer column. NULL rows fail an equality test."""
    preds = []
    if _is_on(spec.clinic, ALL_CLINICS):
        preds.append(F.col(cols.clinic) == spec.clinic)
    if _is_on(spec.doctor, ALL_DOCTORS):
        preds.append(F.col(cols.doctor) == spec.doctor)
    if _is_on(spec.payer, ALL_PAYERS) and cols.payer in columns:
        preds.append(F.col(cols.payer) == spec.payer)
    return preds


def filter_predicate(spec: FilterSpec, columns: Sequence[str],
                     cols: Columns = DEFAULT_COLUMNS) -> Column | None:
    """AND of the time range and the category tests; None = keep all."""
    preds: list[Column] = []
    if spec.start and spec.end:
        has_date = cols.date in columns
        if spec.kind == "tanggal":
            preds.append(date_range(spec.start, spec.end, cols))
        elif spec.kind == "bulan":
            preds.append(month_range(spec.start, spec.end, cols, with_date=has_date))
        elif spec.kind == "tahun":
            preds.append(year_range(spec.start, spec.end, cols, with_date=has_date))
    preds.extend(category_predicates(spec, columns, cols))
    if not preds:
        return None
    out = preds[0]
    for p in preds[1:]:
        out = out & p
    return out


def apply_filters(df: DataFrame, spec: FilterSpec, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """the filtered frame (lazy; one Filter node)."""
    pred = filter_predicate(spec, df.columns, cols)
    return df if pred is None else df.where(pred)


def keep_top_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """rows whose ``key`` is among the n most frequent keys.

    The top set has at most n rows (a proven bound), so it is broadcast into a
    left-semi join; nothing is collected to the driver.
    """
    top = (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
           .orderBy(F.desc("_n"), F.col(key)).limit(n).select(key))
    return df.join(F.broadcast(top), on=key, how="left_semi")


def month_selection_range(selected_labels: Sequence[str]) -> tuple[dt.date, dt.date] | None:
    """F8 for months: first and last label *in selection order* are the ends
    ('January 2025' -> 2025-01-01). Nothing chosen -> None (full range)."""
    if not selected_labels:
        return None
    first = dt.datetime.strptime(selected_labels[0], "%B %Y").date()
    last = dt.datetime.strptime(selected_labels[-1], "%B %Y").date()
    return first, last


def year_selection_range(selected_years: Sequence[str]) -> tuple[dt.date, dt.date] | None:
    """F8 for years: 1 Jan of the first chosen year .. 31 Dec of the last."""
    if not selected_years:
        return None
    return dt.date(int(selected_years[0]), 1, 1), dt.date(int(selected_years[-1]), 12, 31)


def selection_spec(kind: str, bounds: tuple[dt.date, dt.date] | None, **categories) -> FilterSpec:
    """F8: a spec from chosen bounds; none chosen or start > end -> full range."""
    if bounds is None or bounds[0] > bounds[1]:
        return FilterSpec(kind=None, **categories)
    return FilterSpec(kind=kind, start=bounds[0], end=bounds[1], **categories)
