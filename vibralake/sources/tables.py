"""Keyed tables, append logs and small result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vibralake.sources.readings import read_table


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a log; nothing is compared with what is there."""
    rows.write.mode("append").parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or an empty one with the same columns where it is missing."""
    found = read_table(spark, path)
    return spark.createDataFrame([], schema) if found is None else found


def write_version(df: DataFrame, base: str) -> str:
    """Write a table under a new version folder and return the folder.

    A plain folder must not be overwritten while it is being read, which an
    upsert of a table into itself would do.
    """
    import time

    path = f"{base.rstrip('/')}/version={time.time_ns()}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_texts(documents: DataFrame, path: str, name: str = "doc_name") -> None:
    """One text per document stem."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    documents.select(stem.alias("stem"), "text").write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested result rows as JSON, null fields included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
