"""Set operations that keep counts, and the anti join with the meaning of NOT IN.

``DataFrame.intersectAll`` and ``exceptAll`` are union, count per row and
replication in Spark; here the counts are kept on the rows, so a row that stands
in a third of a table stays one row through the shuffle and is repeated (if at
all) in several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Copies of one row that are made in one place.
CHUNK = 10_000


def counted(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of both (nulls equal nulls) with ``_left`` and ``_right``, their counts.

    Columns go by position, as in SQL, and take the left names.
    """
    if len(left.columns) != len(right.columns):
        raise ValueError(f"{len(left.columns)} columns against {len(right.columns)}")
    names = left.columns
    right = right.toDF(*names)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = left.withColumns({"_left": one, "_right": none}).unionAll(
        right.withColumns({"_left": none, "_right": one}))
    return both.groupBy(*(F.col(f"`{c}`") for c in names)).agg(
        F.sum("_left").alias("_left"), F.sum("_right").alias("_right"))


def replicate(df: DataFrame, times: Column, columns: Sequence[str]) -> DataFrame:
    """Each row ``times`` times (none for 0 or less); a row with many copies is dealt in chunks."""
    chunks = (df.withColumn("_times", times).where("_times > 0")
              .withColumn("_chunk", F.explode(F.sequence(
                  F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / CHUNK))))
              .withColumn("_here", F.least(F.lit(CHUNK).cast("long"),
                                           F.col("_times") - F.col("_chunk") * CHUNK)))
    dealt = chunks.repartition(F.xxhash64(*(F.col(f"`{c}`") for c in columns)), F.col("_chunk"))
    return (dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_here")))
            .select(*(F.col(f"`{c}`") for c in columns)))


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both, each as often as in the side that has it less often."""
    return replicate(counted(left, right), F.least("_left", "_right"), left.columns)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows, each as often as left has it more than right."""
    return replicate(counted(left, right), F.col("_left") - F.col("_right"), left.columns)


def not_in(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Left rows for which ``left_key NOT IN (SELECT right_key FROM right)`` is true.

    An empty right side keeps all rows, those with a null key too. Else a null
    right key keeps none, and a null left key is not kept. The join is an
    ordinary anti join on distinct keys.
    """
    keys = right.select(F.col(f"`{right_key}`").alias("_key"))
    # One struct of two numbers, read once as a scalar subquery.
    facts = keys.agg(F.struct(F.count(F.lit(1)).alias("n"),
                              F.count_if(F.col("_key").isNull()).alias("nulls"))).scalar()
    rest = left.join(keys.na.drop().distinct(), F.col(f"`{left_key}`") == F.col("_key"), "left_anti")
    return rest.where((facts["n"] == 0) | ((facts["nulls"] == 0) & F.col(f"`{left_key}`").isNotNull()))
