"""Page texts of technical manuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vibralake import schemas
from vibralake.operators import documents


def read_pages(spark: SparkSession, path: str, pattern: str = r"^Doc.*\.pdf$") -> DataFrame:
    """Extracted pages of the manuals whose names fit the pattern."""
    return documents.discover(spark.read.schema(schemas.PAGES).parquet(path), pattern)
