"""Per-group aggregates that pandas expressed as lambdas (A1–A3).

All three share one shape: aggregate to one row per (key, value), rank the
values inside each key with ``row_number() <= k`` and join the survivors into
text. Spark plans the ranking with a *partial* ``WindowGroupLimit`` before the
shuffle on the key, so every task keeps at most k rows per key: the state is
bounded by k, not by the size of the group, and a key holding a third of all
rows never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RN = "_rn"
_FIRST = "_first"
_N = "_n"


def _not_null(cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def order_value(order_by: Sequence[str]) -> Column:
    """The row-order value: the column itself when there is one (a numeric or
    time column keeps the aggregate hash-based), else a struct compared field
    by field (Spark aggregates a struct minimum with a sort-based aggregate)."""
    if len(order_by) == 1:
        return F.col(order_by[0])
    return F.struct(*[F.col(c) for c in order_by])


def _join_ranked(ranked: DataFrame, keys: Sequence[str], value: str, out: str,
                 sep: str) -> DataFrame:
    """(keys, value, rn) with rn <= k -> (keys, 'v1, v2, ...') in rn order.

    The input is already clustered by ``keys`` (window output), so this
    aggregate adds no shuffle; each list holds at most k entries.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(_RN), F.col(value).alias("v"))))
    return ranked.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda s: s["v"]), sep).alias(out))


def first_k_distinct(df: DataFrame, keys: Sequence[str], value: str, k: int,
                     order_by: Sequence[str], out: str, sep: str = ", ",
                     first_col: str | None = None) -> DataFrame:
    """A1: the first k distinct non-null values of ``value`` in row order.

    Row order is given by ``order_by`` (explicit columns, decision D6).
    ``first_col``: the input is pre-aggregated and carries, per row, the
    smallest order struct of the rows it stands for. Returns one row per key
    that has a non-null value.
    """
    first = F.col(first_col) if first_col else order_value(order_by)
    first_seen = (
        df.where(_not_null([*keys, value]))
        .groupBy(*keys, value)
        .agg(F.min(first).alias(_FIRST))
    )
    w = Window.partitionBy(*keys).orderBy(F.col(_FIRST), F.col(value))
    ranked = first_seen.withColumn(_RN, F.row_number().over(w)).where(F.col(_RN) <= k)
    return _join_ranked(ranked, keys, value, out, sep)


def _value_counts(df: DataFrame, keys: Sequence[str], value: str,
                  count_col: str | None) -> DataFrame:
    n = F.sum(count_col) if count_col else F.count(F.lit(1))
    return df.where(_not_null([*keys, value])).groupBy(*keys, value).agg(n.alias(_N))


def top_k_values(df: DataFrame, keys: Sequence[str], value: str, k: int, out: str,
                 sep: str = ", ", count_col: str | None = None) -> DataFrame:
    """A3: the k most frequent non-null values, most frequent first.

    Ties go to the smaller value (decision D5). ``count_col``: the input is
    pre-aggregated and this column holds each row's row count. One row per
    key that has a non-null value.
    """
    counts = _value_counts(df, keys, value, count_col)
    w = Window.partitionBy(*keys).orderBy(F.desc(_N), F.col(value))
    ranked = counts.withColumn(_RN, F.row_number().over(w)).where(F.col(_RN) <= k)
    return _join_ranked(ranked, keys, value, out, sep)


def mode_or(df: DataFrame, keys: Sequence[str], value: str, out: str,
            count_col: str | None = None) -> DataFrame:
    """A2: the most frequent non-null value (ties -> smallest).

    Keys whose values are all null get no row; callers left-join and
    ``coalesce`` to their default, or use ``mode_or_default``.
    """
    counts = _value_counts(df, keys, value, count_col)
    w = Window.partitionBy(*keys).orderBy(F.desc(_N), F.col(value))
    return (counts.withColumn(_RN, F.row_number().over(w)).where(F.col(_RN) == 1)
            .select(*keys, F.col(value).alias(out)))


def mode_or_default(df: DataFrame, keys: Sequence[str], value: str, out: str,
                    default: str) -> DataFrame:
    """A2 for every key, in one pass: NULL ranks behind all values, so a key
    without any gets ``default``."""
    counts = (df.where(_not_null(keys)).groupBy(*keys, value)
              .agg(F.count(F.lit(1)).alias(_N)))
    w = Window.partitionBy(*keys).orderBy(F.col(value).isNull(), F.desc(_N), F.col(value))
    return (counts.withColumn(_RN, F.row_number().over(w)).where(F.col(_RN) == 1)
            .select(*keys, F.coalesce(value, F.lit(default)).alias(out)))
