"""CSV feeds of different layouts -> one canonical text table.

Everything lands as text with an explicit schema (nothing inferred, ids stay
text); typing happens in ``operators.clean``. The readers are plain
``spark.read.csv`` scans, so each file split is read by its own task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costmart.schema import (
    CANONICAL,
    DEFAULT_COLUMNS,
    FEED_A_COLUMNS,
    FEED_B_RENAME,
    NA_TOKENS,
    string_schema,
)


@dataclass(frozen=True)
class FeedSpec:
    """How one feed is laid out.

    ``columns``: names by position for a headerless feed (its width is checked).
    ``rename``: source header name -> canonical name for a feed with a header.
    ``copy_payer``: copy the payer into ``sumber_pembayaran`` (feed B).
    ``multi_line``: a quoted field may hold line breaks, so a file is one task's
    work (the price; feeds come as many files). Without it files are split, for
    feeds known to have no such field: the halves of a broken record then count
    as malformed.
    ``malformed``: ``raise`` fails the job on a record with surplus fields or
    an open quote; records that are too short get NULLs for the missing fields.
    ``mark`` keeps all records and flags these three in a boolean column
    ``malformed``.
    """

    path: str
    sep: str = ","
    header: bool = False
    columns: Sequence[str] | None = None
    rename: dict[str, str] = field(default_factory=dict)
    copy_payer: bool = False
    encoding: str = "UTF-8"
    malformed: str = "raise"
    multi_line: bool = True


def feed_a(path: str) -> FeedSpec:
    return FeedSpec(path=path, sep=",", header=False, columns=FEED_A_COLUMNS)


def feed_b(path: str) -> FeedSpec:
    return FeedSpec(path=path, sep=";", header=True, rename=FEED_B_RENAME, copy_payer=True)


def _reader(spark: SparkSession, spec: FeedSpec):
    return (spark.read.option("sep", spec.sep).option("header", spec.header)
            .option("encoding", spec.encoding).option("escape", '"')
            .option("multiLine", spec.multi_line)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            # Every field is parsed, else a count would not see a surplus one.
            .option("columnPruning", False))


CORRUPT = "_corrupt_record"


def landing_schema(names: Sequence[str]) -> T.StructType:
    """The feed's text columns and the raw line of any row of another width."""
    return string_schema([*names, CORRUPT])


def check_width(df: DataFrame, spec: FeedSpec, width: int) -> DataFrame:
    """Fail on, or flag, records of another width or with an open quote; no field is lost unseen."""
    bare = F.regexp_replace(F.col(CORRUPT), '"([^"]|"")*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(spec.sep), F.lit(""))) + 1
    opened = bare.contains('"')
    # Spark does not answer queries of the raw line alone, so the first field is looked at too.
    seen = F.coalesce(F.length(F.col(f"`{df.columns[0]}`")), F.lit(0)) >= 0
    if spec.malformed == "mark":
        odd = F.when((fields != width) | opened, seen).otherwise(F.lit(False))
        return df.withColumn("malformed", odd).drop(CORRUPT)
    if spec.malformed != "raise":
        raise ValueError(f"malformed must be 'raise' or 'mark', not {spec.malformed!r}")
    message = F.concat(F.lit(f"{spec.path}: more than {width} fields or an open quote: "),
                       F.col(CORRUPT))
    wrong = F.when((fields > width) | ((fields < width) & opened), seen).otherwise(F.lit(False))
    passed = F.when(wrong, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return df.where(passed).drop(CORRUPT)


def read_feed(spark: SparkSession, spec: FeedSpec) -> DataFrame:
    """One feed as canonical-named text columns."""
    if spec.columns is not None and not spec.header:
        # Positional names apply only if the file has exactly that width.
        width = len(_reader(spark, spec).csv(spec.path).columns)
        if width != len(spec.columns):
            raise ValueError(
                f"{spec.path}: expected {len(spec.columns)} columns, found {width}")
        df = _reader(spark, spec).schema(landing_schema(spec.columns)).csv(spec.path)
        df = check_width(df, spec, width)
    else:
        names = _reader(spark, spec).csv(spec.path).columns
        # enforceSchema off: every file's header must have these names in this order.
        df = (_reader(spark, spec).option("enforceSchema", False)
              .schema(landing_schema(names)).csv(spec.path))
        df = check_width(df, spec, len(names))
        if spec.rename:
            df = df.withColumnsRenamed(spec.rename)        # S3
    if spec.copy_payer and "jenis_jaminan" in df.columns:
        df = df.withColumn("sumber_pembayaran", F.col("jenis_jaminan"))   # S4
    return df


def null_tokens(c: Column, tokens: Sequence[str] = NA_TOKENS) -> Column:
    """The CSV reader's missing-value words become NULL (whole, untrimmed)."""
    return F.when(c.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


def unify(feeds: Sequence[DataFrame], columns: Sequence[str] = CANONICAL) -> DataFrame:
    """S5 + S6: union by name (missing columns -> NULL, duplicates kept), the
    canonical columns in order, NA words -> NULL; then the feed's place in
    ``feeds`` (``feed``), which comes first in the row order."""
    numbered = [f.withColumn(DEFAULT_COLUMNS.feed, F.lit(i)) for i, f in enumerate(feeds)]
    out = numbered[0]
    for f in numbered[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    for c in columns:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    marks = [c for c in ("malformed",) if c in out.columns]
    return out.select(*[null_tokens(F.col(c).cast("string")).alias(c) for c in columns],
                      DEFAULT_COLUMNS.feed, *marks)


def read_feeds(spark: SparkSession, specs: Sequence[FeedSpec]) -> DataFrame:
    """All feeds as one canonical text table."""
    return unify([read_feed(spark, s) for s in specs])
