"""Fault classifier: training, scoring, evaluation and persistence."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vibralake import domain
from vibralake.functions import arrays
from vibralake.operators import evaluation, forest as growing, split
from vibralake.session import durable

# Fixed value: a node with fewer rows is not split.
SPLIT_ROWS = 5

Model = growing.Model


class Forest(NamedTuple):
    """Forest settings."""

    trees: int = 100
    depth: int = 20
    leaf_rows: int = 2
    seed: int = domain.SPLIT_SEED


def train(
    train_rows: DataFrame,
    features: Sequence[str] = domain.FEATURES,
    label: str = "fault_category",
    forest: Forest = Forest(),
    split_rows: int = SPLIT_ROWS,
) -> Model:
    """Fit label index, scale and forest on the train rows only; rows without a label take no part."""
    return growing.fit(train_rows, features, label, forest.trees, forest.depth, forest.leaf_rows, split_rows, forest.seed)


def classes(model: Model) -> list[str]:
    return model.classes


def score(model: Model, events: DataFrame, label: str = "fault_category") -> DataFrame:
    """Add predicted category, confidence and the probability map.

    Works on batch and streaming frames. An event needs no label; rows are
    never dropped.
    """
    labels = F.array(*[F.lit(n) for n in model.classes])
    given = events if label in events.columns else events.withColumn(label, F.lit(None).cast("string"))
    scored = growing.with_probabilities(model, given, "probabilities_array")
    return scored.select(
        *events.columns,
        arrays.predicted(labels, F.col("probabilities_array")).alias("predicted_category"),
        arrays.confidence(F.col("probabilities_array")).alias("confidence"),
        arrays.probability_map(labels, F.col("probabilities_array")).alias("probabilities"),
        arrays.top_probabilities(labels, F.col("probabilities_array"), domain.SHOWN_PROBABILITIES).alias("top_probabilities"),
    )


def feature_importance(model: Model, features: Sequence[str] = domain.FEATURES) -> list[tuple[str, float]]:
    """Every feature with its importance, greatest first."""
    return sorted(zip(features, model.importances().tolist(), strict=True), key=lambda p: -p[1])


def importance_frame(spark: SparkSession, model: Model, features: Sequence[str] = domain.FEATURES, n: int = 10) -> DataFrame:
    return (
        spark.createDataFrame(feature_importance(model, features), "feature string, importance double")
        .orderBy(F.desc("importance"), "feature")
        .limit(n)
    )


def train_and_evaluate(
    readings: DataFrame,
    key: str = "id",
    features: Sequence[str] = domain.FEATURES,
    label: str = "fault_category",
    forest: Forest = Forest(),
) -> tuple[Model, DataFrame]:
    """Split, fit and measure; the second result is one evaluation row."""
    marked = split.stratified_split(readings, label, key)
    model = train(marked.filter("not is_test"), features, label, forest)
    tested = score(model, marked.filter("is_test"), label)
    pairs = evaluation.pair_counts(tested, label, "predicted_category")
    return model, evaluation_record(pairs, model, features, readings)


def evaluation_record(pairs: DataFrame, model: Model, features: Sequence[str], readings: DataFrame) -> DataFrame:
    """Summary, report, matrix, top features and counts as one nested row."""
    pairs = durable(pairs)
    report = evaluation.class_report(pairs)
    names = classes(model)
    top = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(v).alias("importance")) for f, v in feature_importance(model, features)[:10]])
    rows = report.agg(F.array_sort(F.collect_list(F.struct("class", "precision", "recall", "f1", "support"))).alias("classification_report"))
    cells = evaluation.confusion_matrix(pairs).agg(F.array_sort(F.collect_list(F.struct("label", "prediction", "n"))).alias("confusion_matrix"))
    total = readings.agg(F.count("*").alias("total_samples"))
    parts = [evaluation.metric_summary(report).withColumnRenamed("support", "test_samples"), rows, cells, total]
    one = parts[0]
    for part in parts[1:]:
        one = one.unionByName(part, allowMissingColumns=True)
    # Four one-row results stacked and folded into one row.
    return one.agg(*[F.first(c, ignorenulls=True).alias(c) for c in one.columns]).withColumns(
        {"classes": F.array(*[F.lit(n) for n in names]), "top_features": top}
    )


def save(model: Model, path: str) -> None:
    growing.save(model, path)


def load(path: str) -> Model:
    return growing.load(path)
