"""Joins and measures along an order: as-of and interval joins, smaller counts, running and
rolling measures.

Rows are dealt by range over (keys, order), so a key that holds a third of all
rows is cut into several parts, and no window sees more than one part. What a
part needs from the parts before it (the last match, a sum) is carried: one row
per key and part, of which only a key that runs on over a border keeps any, at
most one per part. Windows are always keyed by the part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costmart.session import materialise

PART = "_part"
#: Rows of one bin that one task joins; fuller bins are salted.
BIN_ROWS = 200_000


def split_ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  parts: int | None = None) -> DataFrame:
    """``df`` with the number of its range over (keys, order), written once.

    ``parts`` defaults to the session's shuffle partitions. Rows that are equal
    in all these columns share a part; give ``order`` a last column that tells
    them apart if they can be many.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys, *order)
    return materialise(dealt.withColumn(PART, F.spark_partition_id()), "ordered")


def _carried(dealt: DataFrame, keys: Sequence[str], partial: Column, total) -> DataFrame:
    """``dealt`` with ``_carry``: ``total`` of the partial results of the parts before.

    The carry has at most one row per part: the ranges ascend, so only a part's
    first key can have begun before it. That bounds the broadcast.
    """
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = (dealt.groupBy(PART, *keys).agg(partial.alias("_partial"))
             .select(F.col(PART).alias("_carry_part"),
                     *(F.col(k).alias(f"_carry_{k}") for k in keys),
                     total(F.col("_partial")).over(before).alias("_carry"))
             .where(F.col("_carry").isNotNull()))
    same = F.col(PART) == F.col("_carry_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_carry_{k}"))
    return (dealt.join(F.broadcast(carry), same, "left")
            .drop("_carry_part", *(f"_carry_{k}" for k in keys)))


def _tagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], side: int, name: str,
            other: tuple[str, str]) -> DataFrame:
    """keys k0.., order o0.., the side, and the whole row as a struct under ``name``."""
    return df.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)),
                     *(F.col(f"`{o}`").alias(f"o{i}") for i, o in enumerate(order)),
                     F.lit(side).alias("side"),
                     F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name),
                     F.lit(None).cast(other[1]).alias(other[0]))


def _struct_type(df: DataFrame) -> str:
    return f"struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in df.schema)}>"


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str,
              right_time: str, values: Sequence[str], tie_break: str, prefix: str = "last_",
              strict: bool = False, parts: int | None = None) -> DataFrame:
    """Every left row with the ``values`` of the key's last right row at or before its time.

    ``strict`` takes rows before its time only. Of right rows at one time the
    one with the greatest ``tie_break`` counts (nulls first). Left rows without
    a match, with a null key or with a null time keep NULLs; right rows with a
    null key or time match nothing; repeated left rows stay. Each value gets
    ``prefix``, which must keep it apart from the left columns (``ValueError``).
    """
    clash = {f"{prefix}{v}".lower() for v in values} & {c.lower() for c in left.columns}
    if clash:
        raise ValueError(f"result columns clash with the left side: {sorted(clash)}")
    needed = right.select(*dict.fromkeys([*keys, right_time, tie_break, *values])).na.drop(
        subset=[*keys, right_time])
    l_type, r_type = _struct_type(left), _struct_type(needed)
    names = [f"k{i}" for i in range(len(keys))]
    matched = left.na.drop(subset=[*keys, left_time])
    both = _tagged(matched, keys, [left_time], 0 if strict else 1, "l", ("r", r_type)) \
        .withColumn("tie", F.lit(None).cast(needed.schema[tie_break].dataType)) \
        .unionByName(_tagged(needed, keys, [right_time], 1 if strict else 0, "r", ("l", l_type))
                     .withColumn("tie", F.col(f"r.`{tie_break}`")))
    dealt = split_ordered(both, names, ["o0", "side", "tie"], parts)
    found = _carried(
        dealt, names, F.max_by("r", F.when(F.col("r").isNotNull(), F.struct("o0", "tie"))),
        lambda p: F.last(p, ignorenulls=True))
    so_far = (Window.partitionBy(PART, *names).orderBy("o0", "side", "tie")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = (found.withColumn("m", F.coalesce(F.last("r", ignorenulls=True).over(so_far), "_carry"))
             .where(F.col("l").isNotNull())
             .select("l.*", *(F.col(f"m.`{v}`").alias(f"{prefix}{v}") for v in values)))
    missing = F.lit(False)
    for c in [*keys, left_time]:
        missing |= F.col(f"`{c}`").isNull()
    rest = left.where(missing).select("*", *(
        F.lit(None).cast(right.schema[v].dataType).alias(f"{prefix}{v}") for v in values))
    return found.unionByName(rest)


def interval_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str,
                  before: int, after: int, keys: Sequence[str] = (), prefix: str = "near_",
                  bin_rows: int = BIN_ROWS, totals: dict[str, Column] | None = None,
                  parts: int | None = None) -> DataFrame:
    """Pairs of rows with right_time in [left_time - before, left_time + after] seconds.

    Time is cut into bins as wide as the interval, so a left row stands in two
    bins at most; a right row in one, so each pair is found once. Bins (with
    their keys) of more than ``bin_rows`` right rows are salted: the right rows
    are dealt over salts, left rows are repeated for each. Rows with a null time
    or key pair with nothing. Right columns get ``prefix``.

    ``totals`` (name to a number of a right row) asks for sums over the pairs
    instead of the pairs: each left row that has a partner, once, with the sum
    of each number over its partners (NULL if all are). No pair is made, so the
    work grows with the rows, however many fall into one interval.
    """
    if totals is not None:
        return _interval_totals(left, right, left_time, right_time, before * 1_000_000,
                                after * 1_000_000, keys, totals, parts)
    before, after = before * 1_000_000, after * 1_000_000
    width = max(1, before + after)

    def micros(name: str) -> Column:
        return F.unix_micros(F.col(f"`{name}`").cast("timestamp"))

    rights = right.select(*(F.col(f"`{c}`").alias(f"{prefix}{c}") for c in right.columns))
    names = [f"{prefix}{k}" for k in keys]
    rights = rights.withColumn("_t", micros(f"{prefix}{right_time}")).where("_t IS NOT NULL") \
        .withColumn("_bin", F.floor(F.col("_t") / width))
    sizes = (rights.groupBy("_bin", *names).agg(F.count(F.lit(1)).alias("_n"))
             .where(F.col("_n") > bin_rows)
             .select("_bin", *names, F.ceil(F.col("_n") / bin_rows).cast("int").alias("_salts")))
    on = ["_bin", *names]
    rights = (rights.join(sizes, on, "left")
              .withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(
                  F.pmod(F.xxhash64(*rights.columns), F.col("_salts")).cast("int")))
              .drop("_salts"))
    lefts = (left.withColumn("_lt", micros(left_time)).where("_lt IS NOT NULL")
             .withColumns({n: F.col(f"`{k}`") for n, k in zip(names, keys)})
             .withColumn("_bin", F.explode(F.sequence(
                 F.floor((F.col("_lt") - before) / width),
                 F.floor((F.col("_lt") + after) / width))))
             .join(sizes, on, "left")
             .withColumn("_salt", F.explode(F.sequence(
                 F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
             .drop("_salts"))
    return (lefts.join(rights, [*on, "_salt"])
            .where(F.col("_t").between(F.col("_lt") - before, F.col("_lt") + after))
            .select(*(F.col(f"`{c}`") for c in left.columns),
                    *(F.col(f"`{prefix}{c}`") for c in right.columns)))


def _interval_totals(left: DataFrame, right: DataFrame, left_time: str, right_time: str,
                     before: int, after: int, keys: Sequence[str], totals: dict[str, Column],
                     parts: int | None) -> DataFrame:
    """Sums over an interval as the difference of two running sums (times in microseconds).

    Every left row puts two marks into the order of the right rows: one before
    the first row of its interval, one behind the last. Right rows of one time
    are summed up first, so a time that many share is a few rows.
    """
    def micros(name: str) -> Column:
        return F.unix_micros(F.col(f"`{name}`").cast("timestamp"))

    names = [f"k{i}" for i in range(len(keys))]
    told = [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]
    sums = [f"s{i}" for i in range(len(totals))]
    counts = [f"n{i}" for i in range(len(totals))]
    measures = ["rows", *sums, *counts]
    rights = (right.select(*told, micros(right_time).alias("at"),
                           *(c.alias(s) for s, c in zip(sums, totals.values())))
              .na.drop(subset=["at", *names]).groupBy(*names, "at")
              .agg(F.count(F.lit(1)).alias("rows"), *(F.sum(s).alias(s) for s in sums),
                   *(F.count(s).alias(n) for s, n in zip(sums, counts)))
              .withColumns({"side": F.lit(1), "tie": F.lit(0).cast("long")}))
    kinds = {f.name: f.dataType for f in rights.schema}
    # Rows that are equal in all columns get one number each, so each row's two marks meet.
    lefts = materialise(left.withColumn("_lt", micros(left_time)).na.drop(subset=["_lt", *keys])
                        .withColumn("_id", F.monotonically_increasing_id()), "interval-left")
    marks = lefts.select(*told, F.col("_id").alias("tie"), F.explode(F.array(
        F.struct((F.col("_lt") - before).alias("at"), F.lit(0).alias("side")),
        F.struct((F.col("_lt") + after).alias("at"), F.lit(2).alias("side")))).alias("m")) \
        .select(*names, "m.at", "m.side", "tie",
                *(F.lit(None).cast(kinds[m]).alias(m) for m in measures))
    both = rights.unionByName(marks).withColumn("all", F.lit(0))
    group = ["all", *names]
    dealt = split_ordered(both, group, ["at", "side", "tie"], parts)
    so_far = (Window.partitionBy(PART, *group).orderBy("at", "side", "tie")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    zero = {m: F.lit(0).cast(kinds[m]) for m in measures}
    carried = F.struct(*(F.coalesce(F.sum(m), zero[m]).alias(m) for m in measures))

    def summed(partial: Column, over) -> Column:
        return F.struct(*(F.sum(partial[m]).over(over).alias(m) for m in measures))

    before_part = (Window.partitionBy(*group).orderBy(PART)
                   .rowsBetween(Window.unboundedPreceding, -1))
    # At most one row a part, as in ``_carried``.
    carry = (dealt.groupBy(PART, *group).agg(carried.alias("p"))
             .select(F.col(PART).alias("_carry_part"), *(F.col(g).alias(f"_carry_{g}") for g in group),
                     summed(F.col("p"), before_part).alias("_carry"))
             .where(F.col("_carry.rows").isNotNull()))
    same = F.col(PART) == F.col("_carry_part")
    for g in group:
        same &= F.col(g) == F.col(f"_carry_{g}")
    found = dealt.join(F.broadcast(carry), same, "left")
    found = found.select("tie", "side", *(
        (F.coalesce(F.sum(m).over(so_far), zero[m]) + F.coalesce(F.col("_carry")[m], zero[m]))
        .alias(m) for m in measures)).where(F.col("side") != 1)

    def within(m: str) -> Column:
        return (F.max(F.when(F.col("side") == 2, F.col(m)))
                - F.max(F.when(F.col("side") == 0, F.col(m))))

    sums_of = found.groupBy(F.col("tie").alias("_id")).agg(*(within(m).alias(f"_{m}") for m in measures))
    return (lefts.join(sums_of.where(F.col("_rows") > 0), "_id")
            .select(*(F.col(f"`{c}`") for c in left.columns),
                    *(F.when(F.col(f"_{n}") > 0, F.col(f"_{s}")).alias(name)
                      for name, s, n in zip(totals, sums, counts))))


def count_smaller(left: DataFrame, right: DataFrame, left_value: str, right_value: str,
                  name: str = "n_smaller", parts: int | None = None) -> DataFrame:
    """Every left row with the number of right rows whose value is smaller; no pairs are made.

    A distributed rank: both sides in one order, the right rows of a part
    counted along it, the sums of the parts before carried. Null right values
    are not smaller than anything; a null left value has the count NULL.
    """
    l_type = _struct_type(left)
    rights = right.select(F.col(f"`{right_value}`").alias("v")).na.drop()
    # Equal right values are one row each part: their count stands for them.
    rights = rights.groupBy("v").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(0).alias("all"), "v", F.lit(1).alias("side"), F.lit(0).cast("long").alias("tie"),
        "n", F.lit(None).cast(l_type).alias("l"))
    lefts = left.na.drop(subset=[left_value]).select(
        F.lit(0).alias("all"), F.col(f"`{left_value}`").alias("v"), F.lit(0).alias("side"),
        F.xxhash64(*(F.col(f"`{c}`") for c in left.columns)).alias("tie"),
        F.lit(0).cast("long").alias("n"),
        F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("l"))
    dealt = split_ordered(lefts.unionByName(rights), ["all"], ["v", "side", "tie"], parts)
    so_far = (Window.partitionBy(PART, "all").orderBy("v", "side", "tie")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = _carried(dealt, ["all"], F.sum("n"), F.sum)
    counted = (found.withColumn("c", F.sum("n").over(so_far) + F.coalesce("_carry", F.lit(0)))
               .where(F.col("l").isNotNull()).select("l.*", F.col("c").alias(name)))
    return counted.unionByName(left.where(F.col(f"`{left_value}`").isNull())
                               .withColumn(name, F.lit(None).cast("long")))


def running_total(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = (),
                  name: str = "running_total", parts: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row, per key or over all rows.

    ``order`` must tell rows apart for a defined result. Null values add
    nothing (a total before the first value is NULL, as in SQL); null keys are a
    key like any other.
    """
    one = df.withColumn("_all", F.lit(0))
    dealt = split_ordered(one, ["_all", *keys], order, parts)
    so_far = (Window.partitionBy(PART, "_all", *keys).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = F.sum(value).over(so_far)
    found = _carried(dealt, ["_all", *keys], F.sum(value), F.sum)
    total = F.when(F.col("_carry").isNull(), within).otherwise(
        F.col("_carry") + F.coalesce(within, F.lit(0)))
    return found.withColumn(name, total).select(*df.columns, name)


def rolling_sum(df: DataFrame, value: str, day: str, days: int, keys: Sequence[str] = (),
                bucket_days: int = 64, name: str = "rolling") -> DataFrame:
    """``df`` with the sum and the number of values (``name``_n) of the last ``days`` days.

    A frame covers the ``days`` dates that end with the row's own. Dates are cut
    into buckets; the rows within reach of the next buckets are repeated there
    as halo rows, so a window holds one bucket of a key. Meant for rows already
    summed per key and date, which bounds a bucket; other rows are right too.
    Rows with a null date have NULL results.
    """
    size = max(bucket_days, days)
    at = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    rows = df.withColumn("_day", at).withColumn("_bucket", F.floor(F.col("_day") / size))
    halo = (rows.where((F.col("_day") + days - 1) >= (F.col("_bucket") + 1) * size)
            .withColumn("_bucket", F.col("_bucket") + 1).withColumn("_halo", F.lit(True)))
    both = rows.where("_day IS NOT NULL").withColumn("_halo", F.lit(False)).unionByName(halo)
    frame = (Window.partitionBy("_bucket", *keys).orderBy("_day").rangeBetween(1 - days, 0))
    found = (both.withColumn(name, F.sum(value).over(frame))
             .withColumn(f"{name}_n", F.count(value).over(frame)).where(~F.col("_halo"))
             .select(*df.columns, name, f"{name}_n"))
    return found.unionByName(df.where(F.col(day).isNull()).withColumns({
        name: F.lit(None).cast(found.schema[name].dataType),
        f"{name}_n": F.lit(None).cast("long")}))
