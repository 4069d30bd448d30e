"""Raw operator label -> fault category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vibralake import domain
from vibralake.functions.text import strip
from vibralake.session import computed_once


def clean_label(label: Column) -> Column:
    """Lower-cased label without surrounding white space; null stays null."""
    return F.lower(strip(label))


def category_of(
    clean: Column,
    rules=domain.CATEGORY_RULES,
    states=domain.OPERATIONAL_STATES,
    normal: str = domain.NORMAL,
    unknown: str = domain.UNKNOWN,
    other: str = domain.OTHER_FAULT,
) -> Column:
    """First matching rule for an already cleaned label."""
    chain = F.when(clean.isNull(), F.lit(unknown)).when(clean.isin(*states), F.lit(normal))
    for fragment, category in rules:
        chain = chain.when(clean.contains(fragment), F.lit(category))
    return chain.otherwise(F.lit(other))


def is_problem(category: Column) -> Column:
    return ~category.isin(domain.NORMAL, domain.UNKNOWN)


def is_operational(category: Column) -> Column:
    return category == domain.NORMAL


def with_category(df: DataFrame, label: str = "fault", **rules) -> DataFrame:
    """Add ``fault_category`` and ``is_problem``.

    The cleaned label is its own projection, so the rule chain reads it instead
    of cleaning the text again in every branch, and the category is computed
    once however often it is filtered or grouped by.
    """
    cleaned = df.withColumn("_clean", clean_label(F.col(label)))
    mapped = computed_once(cleaned, fault_category=category_of(F.col("_clean"), **rules))
    return mapped.drop("_clean").withColumn("is_problem", is_problem(F.col("fault_category")))


def label_counts(df: DataFrame, label: str = "fault", **rules) -> DataFrame:
    """Rows per distinct raw label, with its category.

    Grouping first leaves one row per label variant, so the rule chain runs on
    those instead of on every reading; counting combines before the shuffle.
    """
    return with_category(df.groupBy(label).agg(F.count("*").alias("n")), label, **rules)
