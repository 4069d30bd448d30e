"""Counts, KPIs and time distributions over stored readings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def global_counts(readings: DataFrame, documents: DataFrame, prescriptions: DataFrame) -> DataFrame:
    """One row of totals. Each table is counted in its own pass and the one-row
    results are stacked, so no join is needed."""
    parts = [
        readings.agg(
            F.count("*").alias("total_events"), F.count_if(F.col("is_problem")).alias("total_problems")
        ),
        documents.agg(F.count("*").alias("total_docs")),
        prescriptions.agg(F.count("*").alias("total_prescriptions")),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = ("total_events", "total_problems", "total_docs", "total_prescriptions")
    return stacked.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in names])


def normal_ratio(total: Column, problems: Column) -> Column:
    return F.when(total > 0, (total - problems) / (total + F.lit(1e-6)) * 100).otherwise(100.0)


def kpis(readings: DataFrame, documents: DataFrame, prescriptions: DataFrame) -> DataFrame:
    return global_counts(readings, documents, prescriptions).select(
        "total_events",
        "total_problems",
        normal_ratio(F.col("total_events"), F.col("total_problems")).alias("normal_ratio"),
        "total_docs",
        "total_prescriptions",
    )


def category_distribution(readings: DataFrame) -> DataFrame:
    """Rows per category with the problem flag, most frequent first."""
    return (
        readings.groupBy("fault_category")
        .agg(F.count("*").alias("count"), F.max("is_problem").alias("is_problem"))
        .orderBy(F.desc("count"), "fault_category")
    )


def distribution_of_labels(label_counts: DataFrame) -> DataFrame:
    """The same from counts per raw label, see ``labels.label_counts``."""
    return (
        label_counts.groupBy("fault_category")
        .agg(F.sum("n").alias("count"), F.max("is_problem").alias("is_problem"))
        .orderBy(F.desc("count"), "fault_category")
    )


def problem_ranking(distribution: DataFrame) -> DataFrame:
    """Problem categories of a distribution, rarest first."""
    return distribution.filter("is_problem").orderBy("count", "fault_category")


def value_counts(readings: DataFrame, column: str = "fault_category") -> DataFrame:
    return readings.groupBy(column).agg(F.count("*").alias("count"))


def daily_timeline(readings: DataFrame, time: str = "created_at") -> DataFrame:
    """Problem readings per day and category."""
    return (
        readings.filter("is_problem")
        .groupBy(F.to_date(time).alias("date"), "fault_category")
        .agg(F.count("*").alias("occurrences"))
        .orderBy("date", "fault_category")
    )


def daily_counts(readings: DataFrame, time: str = "created_at") -> DataFrame:
    """All readings per category and day, with the day's first and last time.

    Every recurrence figure derives from this table, which has at most one row
    per category and day however many readings a category holds.
    """
    return readings.groupBy("fault_category", F.to_date(time).alias("date")).agg(
        F.count("*").alias("n"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen")
    )


def recurrence(daily: DataFrame) -> DataFrame:
    """Total, events per active day and first/last sighting per category."""
    total, days = F.sum("n"), F.count("date")
    return daily.groupBy("fault_category").agg(
        total.alias("total_occurrences"),
        days.alias("active_days"),
        F.when(days > 1, F.round(total / days, 1)).otherwise(total.cast("double")).alias("events_per_active_day"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def date_histogram(daily: DataFrame) -> DataFrame:
    """Map day -> count per category, in day order."""
    entries = F.array_sort(F.collect_list(F.struct("date", "n")))
    return (
        daily.filter("date is not null")
        .groupBy("fault_category")
        .agg(F.map_from_entries(entries).alias("time_distribution"))
    )
