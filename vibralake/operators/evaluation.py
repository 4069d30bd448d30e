"""Classification metrics from label/prediction counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows per (label, prediction) that occurs."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """Every class pair with its count, 0 where it does not occur.

    The class list is one row; unfolding it twice gives the cells, so their
    number is the square of the number of classes and no table is crossed. A
    missing label or prediction is a class of its own.
    """
    boxed = [F.collect_set(F.struct(F.col(c).alias("c"))) for c in ("label", "prediction")]
    seen = F.array_sort(F.transform(F.array_union(*boxed), lambda s: s["c"]))
    cells = (
        pairs.agg(seen.alias("classes"))
        .select(F.explode("classes").alias("_label"), "classes")
        .select("_label", F.explode("classes").alias("_prediction"))
    )
    same = F.col("_label").eqNullSafe(F.col("label")) & F.col("_prediction").eqNullSafe(F.col("prediction"))
    return cells.join(pairs, same, "left").select(
        F.col("_label").alias("label"), F.col("_prediction").alias("prediction"), F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_wide(pairs: DataFrame, classes: list) -> DataFrame:
    """One row per true class, one column per predicted class."""
    return pairs.groupBy("label").pivot("prediction", classes).agg(F.sum("n")).na.fill(0)


def class_report(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0/0 counts as 0.

    Each pair adds to its true class and to its predicted class, so a single
    aggregation yields all three totals.
    """
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    parts = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("called"), hit.alias("hit")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit")),
            )
        ).alias("p")
    ).select("p.*")
    totals = parts.groupBy("class").agg(
        F.sum("actual").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit")
    )
    zero = F.lit(0.0)
    return (
        totals.withColumn("precision", F.coalesce(F.try_divide("hit", "called"), zero))
        .withColumn("recall", F.coalesce(F.try_divide("hit", "support"), zero))
        .withColumn("f1", F.coalesce(F.try_divide(2 * F.col("hit"), F.col("called") + F.col("support")), zero))
        .select("class", "precision", "recall", "f1", "support", "hit")
    )


def metric_summary(report: DataFrame) -> DataFrame:
    """Accuracy and the macro and support-weighted averages, one row."""
    support = F.sum("support")
    columns = [(F.sum("hit") / support).alias("accuracy")]
    for name in ("precision", "recall", "f1"):
        columns.append(F.avg(name).alias(f"{name}_macro"))
        columns.append((F.sum(F.col(name) * F.col("support")) / support).alias(f"{name}_weighted"))
    return report.agg(*columns, support.alias("support"))
