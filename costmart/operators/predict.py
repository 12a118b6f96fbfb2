"""Cost prediction (M1–M8) with ``pyspark.ml`` — distributed fit and scoring.

The split and the sample are functions of a row's key (an md5 hash salted with
the seed), so they do not depend on partitioning or on the number of
executors, and are the same in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costmart.functions.textfmt import abs_error, rupiah
from costmart.operators.forest import Forest, grow, spark_model
from costmart.schema import FEATURES, MIN_MODEL_ROWS, SAMPLE_POINTS

LABEL = "biaya"
#: Trees that are grown together at most: those of one pass over the rows.
TREE_GROUP = 100


def require_rows(df: DataFrame, n: int = MIN_MODEL_ROWS) -> None:
    """M1: refuse fewer than ``n`` rows (reads at most n rows)."""
    have = df.limit(n).count()
    if have < n:
        raise ValueError(f"too few rows for a model: {have} < {n}")


def feature_table(df: DataFrame, features: Sequence[str] = FEATURES, label: str = LABEL,
                  keep: Sequence[str] = ()) -> DataFrame:
    """M2: numeric features (codes enter as plain numbers) and a double label."""
    return df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features],
                     F.col(label).cast("double").alias("label"))


def hash_bucket(key: Column | str, seed: int = 42, buckets: int = 100) -> Column:
    """0..buckets-1 from the first 32 bits of md5('seed|key')."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), k))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % buckets


def hash_split(df: DataFrame, key: Column | str, seed: int = 42, train_pct: int = 80) -> DataFrame:
    """M3: add ``is_train`` (about train_pct % of rows)."""
    return df.withColumn("is_train", hash_bucket(key, seed) < train_pct)


class ForestModel(PipelineModel):
    """The assembler and Spark's forest; rows are scored in blocks, tree by tree.

    Spark's forest sends each row through all trees, whose nodes do not fit a
    core's cache. The predictions are the same; saved and loaded again, it is
    Spark's own pipeline."""

    def __init__(self, stages: list, forest: Forest, features: Sequence[str]):
        super().__init__(stages)
        self.features, self._mean = list(features), forest.predictor()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        mean = self._mean

        @F.arrow_udf("double")
        def score(*columns: pa.Array) -> pa.Array:
            return pa.array(mean([c.to_numpy(zero_copy_only=False) for c in columns]))

        columns = [F.col(f"`{c}`").cast("double") for c in self.features]
        return self.stages[0].transform(dataset).withColumn("prediction", score(*columns))


def fit_forest(train: DataFrame, features: Sequence[str] = FEATURES, num_trees: int = 100,
               max_depth: int = 10, max_bins: int = 128, seed: int = 42) -> PipelineModel:
    """M4: random forest regressor on the feature table's ``label``.

    Training is distributed: one pass over blocks of binned rows for each
    level, all trees at once as far as their sums fit (``operators.forest``).
    A kept row has its bins and its label, and nothing per tree.
    """
    forest = grow(train, features, num_trees, max_depth, max_bins, seed, TREE_GROUP)
    estimator = RandomForestRegressor(
        featuresCol="features", labelCol="label", predictionCol="prediction", numTrees=num_trees,
        maxDepth=max_depth, maxBins=max_bins, seed=seed, featureSubsetStrategy="all")
    assembler = VectorAssembler(inputCols=list(features), outputCol="features",
                                handleInvalid="keep")
    return ForestModel([assembler, spark_model(train.sparkSession, forest, estimator)], forest,
                       features)


def predict(model: PipelineModel, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """M4: (keep..., actual, prediction, abs_error) for the given rows."""
    scored = model.transform(rows)
    return scored.select(*keep, F.col("label").alias("actual"), "prediction",
                         abs_error("label", "prediction").alias("abs_error"))


def quality_band(r2: Column | str) -> Column:
    """M6: text band of R²."""
    c = F.col(r2) if isinstance(r2, str) else r2
    return (F.when(c > 0.7, "good").when(c > 0.5, "fair").when(c > 0.3, "moderate")
            .otherwise("low"))


def metrics(pred: DataFrame, actual: str = "actual", prediction: str = "prediction",
            digits: int = 4) -> DataFrame:
    """M5 + M6: one row (n, mae, rmse, r2, quality) in a single aggregate pass.

    The total sum of squares is n times the population variance, which Spark
    merges from centred moments: one pass, and no cancellation when the labels
    are large against their spread. A constant label gives R² = 1 if every
    prediction is exact, else 0."""
    y, p = F.col(actual).cast("double"), F.col(prediction).cast("double")
    err = y - p
    parts = pred.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.sum(err * err).alias("_sse"),
        (F.count(y) * F.var_pop(y)).alias("_sst"),
        (F.min(y) == F.max(y)).alias("_constant"),
    )
    out = parts.withColumn(
        "r2", F.when(F.col("_constant"), F.when(F.col("_sse") == 0, 1.0).otherwise(0.0))
        .otherwise(F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_sst"))))
    return out.select(
        "n", F.round("mae", digits).alias("mae"), F.round("rmse", digits).alias("rmse"),
        F.round("r2", digits).alias("r2"), quality_band("r2").alias("quality"))


def metrics_display(m: DataFrame) -> DataFrame:
    """M5 + M6 as shown: errors as 'Rp 1,234', R² with four digits, the band."""
    return m.select("n", rupiah("mae").alias("mae_text"), rupiah("rmse").alias("rmse_text"),
                    F.format_string("%.4f", "r2").alias("r2_text"), "quality")


def data_counts(split: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Rows in all, for training and for testing, and the number of features."""
    return split.agg(F.count(F.lit(1)).alias("n_total"), F.count_if("is_train").alias("n_train"),
                     F.count_if(~F.col("is_train")).alias("n_test"),
                     F.lit(len(features)).alias("n_features"))


def sample_pairs(pred: DataFrame, key: Column | str, n: int = SAMPLE_POINTS,
                 seed: int = 42) -> DataFrame:
    """M7: n rows in md5('seed|key') order: a repeatable top-k."""
    k = F.col(key) if isinstance(key, str) else key
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), k))
    # The error is computed below the sort: limit and sort stay next to each other, and
    # Spark keeps the n rows of each task instead of sorting all.
    return (pred.withColumns({"_h": order, "abs_error": abs_error("actual", "prediction")})
            .orderBy("_h").limit(n).select("actual", "prediction", "abs_error"))


def ideal_line(sample: DataFrame) -> DataFrame:
    """M8: ends of the y = x line: min and max over both columns."""
    return sample.agg(F.min(F.least("actual", "prediction")).alias("lo"),
                      F.max(F.greatest("actual", "prediction")).alias("hi"))


def group_mean_predictions(df: DataFrame, group: str, label: str = LABEL,
                           keep: Sequence[str] = ()) -> DataFrame:
    """A baseline predictor SQL can reproduce: the training mean of the label
    in the row's group (test rows of unseen groups get the global mean)."""
    train = df.where("is_train")
    test = df.where(~F.col("is_train"))
    means = train.groupBy(group).agg(
        (F.sum(label).cast("double") / F.count(label)).alias("_gmean"))
    overall = train.select(F.sum(label).cast("double") / F.count(label)).scalar()
    return (test.join(means, group, "left")
            .select(*keep, F.col(label).cast("double").alias("actual"),
                    F.coalesce(F.col("_gmean"), overall).alias("prediction")))


def forest_report(model: PipelineModel, table: DataFrame, group: str, label: str = "label",
                  tolerance: float = 0.05) -> DataFrame:
    """M5 + M6 of a fitted model against the group-mean predictor, one row.

    ``metrics`` of the test rows and their text, and three checks: ``learns``
    (the model fits its training rows more closely than their group means do,
    which no constant does), ``near_baseline`` (its test MAE is at most
    ``tolerance`` above the group means' MAE) and ``band_fits`` (the band is
    that of the R² shown). Without test rows or training rows a check is false.
    """
    is_test = ~F.col("is_train")
    scored = predict(model, table, keep=["is_train"])
    found = metrics(scored.where(is_test))
    base = metrics(group_mean_predictions(table, group, label)).select("mae").scalar()
    # Around its group's mean, a group's squared error is its count times its variance.
    spread = table.where("is_train").groupBy(group).agg(
        (F.count(label) * F.var_pop(label)).alias("sse")).agg(F.sum("sse")).scalar()
    fitted = scored.where("is_train").agg(
        F.sum((F.col("actual") - F.col("prediction")) ** 2)).scalar()
    texts = {"mae_text": rupiah("mae"), "rmse_text": rupiah("rmse"),
             "r2_text": F.format_string("%.4f", "r2")}
    checks = {"learns": fitted < spread,
              "near_baseline": F.col("mae") <= (1 + tolerance) * base,
              "band_fits": F.col("quality") == quality_band(F.col("r2_text").try_cast("double"))}
    return found.withColumns(texts).withColumns(
        {name: F.coalesce(check, F.lit(False)) for name, check in checks.items()})
