"""Mean and population deviation per feature, and standardised columns."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vibralake.functions import numeric


class Scale(NamedTuple):
    """One number per feature; its size is the number of features."""

    mean: list[float]
    scale: list[float]


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form ``(feature, mean, std, scale)`` from a single pass.

    A zero deviation gives scale 1. The one-row aggregate is unfolded into one
    row per feature, so the input is not read once per column.
    """
    aggs = []
    for c in columns:
        value = numeric.finite_or_zero(F.col(c))
        aggs.append(F.struct(F.lit(c).alias("feature"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")))
    return (
        df.agg(F.array(*aggs).alias("stats"))
        .select(F.inline("stats"))
        .withColumn("scale", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))
    )


def fit_columns(df: DataFrame, columns: Sequence[str]) -> Scale:
    rows = {r["feature"]: r for r in column_stats(df, columns).collect()}
    return Scale([rows[c]["mean"] for c in columns], [rows[c]["scale"] for c in columns])


def array_stats(df: DataFrame, column: str) -> DataFrame:
    """Long form ``(position, mean, std, scale)`` for an array of numbers.

    The summary works on whole vectors with partial aggregation; nothing is
    exploded to a row per element.
    """
    vector = array_to_vector(F.transform(F.col(column), lambda x: numeric.finite_or_zero(x.cast("double"))))
    summary = df.select(vector.alias("v")).agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")
    )
    n = F.col("s.count")
    std = F.sqrt(F.greatest(F.col("x.variance"), F.lit(0.0)) * (n - 1) / n)
    return (
        summary.select(
            "s",
            F.posexplode(
                F.arrays_zip(
                    vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance")
                )
            ).alias("position", "x"),
        )
        .select("position", F.col("x.mean").alias("mean"), std.alias("std"))
        .withColumn("scale", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))
    )


def fit_array(df: DataFrame, column: str) -> Scale:
    rows = array_stats(df, column).orderBy("position").collect()
    return Scale([r["mean"] for r in rows], [r["scale"] for r in rows])


def standardise(df: DataFrame, columns: Sequence[str], scale: Scale) -> DataFrame:
    """Replace each column by ``(value - mean) / scale``; plain projection."""
    return df.withColumns(
        {
            c: (numeric.finite_or_zero(F.col(c)) - F.lit(m)) / F.lit(s)
            for c, m, s in zip(columns, scale.mean, scale.scale, strict=True)
        }
    )
