"""Text columns that hold JSON objects: values by path, key statistics, drift, bad rows.

Everything stays in Spark's own expressions: ``try_parse_json`` parses a value
once into a variant, of which paths are read and whose keys are exploded.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: State of a row's JSON.
MISSING, BAD, OTHER, GOOD = "missing", "bad", "not_object", "object"


def parsed(df: DataFrame, column: str, name: str = "json") -> DataFrame:
    """``df`` with the variant ``name`` and ``name``_state: ``missing`` (null), ``bad`` (no JSON),
    ``not_object`` (JSON of another kind), ``object``."""
    text, variant = F.col(f"`{column}`"), F.col(name)
    kind = F.schema_of_variant(variant)
    state = (F.when(text.isNull(), MISSING).when(variant.isNull(), BAD)
             .when(kind.startswith("OBJECT"), GOOD).otherwise(OTHER))
    return df.withColumn(name, F.try_parse_json(text)).withColumn(f"{name}_state", state)


def extract(df: DataFrame, column: str, paths: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``df`` with a column per entry: name -> (path, type). A path that is absent, a value that
    does not fit the type and bad JSON give NULL."""
    rows = parsed(df, column, "_json")
    return rows.withColumns({n: F.try_variant_get("_json", path, kind)
                             for n, (path, kind) in paths.items()}).drop("_json", "_json_state")


def _entries(df: DataFrame, column: str) -> DataFrame:
    """key, value (text), kind of every top-level entry of every object."""
    rows = parsed(df.select(F.col(f"`{column}`").alias("_text")), "_text", "_json")
    entries = F.explode(F.try_variant_get("_json", "$", "map<string, variant>"))
    return (rows.where(F.col("_json_state") == GOOD).select(entries.alias("key", "_value"))
            .select("key", F.try_variant_get("_value", "$", "string").alias("value"),
                    F.coalesce(F.schema_of_variant("_value"), F.lit("VOID")).alias("kind")))


def key_statistics(df: DataFrame, column: str) -> DataFrame:
    """Per top-level key and kind of value: rows, distinct, least and greatest value as text.

    Summed in each task first: a key in every row is one group, not one task's
    rows; the distinct values are counted over groups of (key, kind, value).
    """
    values = _entries(df, column).groupBy("key", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy("key", "kind").agg(
        F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def drift(df: DataFrame, column: str, expected: Mapping[str, str], period: Column) -> DataFrame:
    """Departures from the ``expected`` kinds (key -> kind, e.g. ``BIGINT``) per period.

    Columns: period, key, found (the kind; the state of rows without an object;
    ``absent`` where an object lacks an expected key), n_rows. Rows as expected
    are not listed, nor are keys outside ``expected`` left out.
    """
    rows = parsed(df.select(period.alias("period"), F.col(f"`{column}`").alias("_text")),
                  "_text", "_json")
    none = rows.where(F.col("_json_state") != GOOD).select(
        "period", F.lit(None).cast("string").alias("key"), F.col("_json_state").alias("found"))
    objects = rows.where(F.col("_json_state") == GOOD).select(
        "period", F.try_variant_get("_json", "$", "map<string, variant>").alias("_map"))
    entries = objects.select("period", F.explode("_map").alias("key", "_value")).select(
        "period", "key", F.coalesce(F.schema_of_variant("_value"), F.lit("VOID")).alias("found"))
    odd = F.lit(True)
    for key, kind in expected.items():
        odd &= ~((F.col("key") == key) & (F.col("found") == kind))
    found = none.unionByName(entries.where(odd))
    if expected:
        lacking = F.array_except(F.array(*(F.lit(k) for k in expected)), F.map_keys("_map"))
        found = found.unionByName(objects.select(
            "period", F.explode(lacking).alias("key"), F.lit("absent").alias("found")))
    return found.groupBy("period", "key", "found").agg(F.count(F.lit(1)).alias("n_rows"))
