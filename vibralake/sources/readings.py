"""Readings from CSV to the stored table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vibralake import domain, schemas
from vibralake.functions import labels, numeric
from vibralake.operators import features


def scan_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Header CSV as text columns with a fixed schema; missing labels are null.

    Paths given as a list may order their columns differently: each is read under its
    own header and they are put together by name. Files of one path must share a header; a
    file with another one is an error when it is read, never a swap of columns.
    """
    paths = [path] if isinstance(path, str) else list(path)
    parts: dict[tuple[str, ...], list[str]] = {}
    for one in paths:
        parts.setdefault(tuple(spark.read.option("header", True).csv(one).columns), []).append(one)
    header = None
    for names, same in parts.items():
        schema = ", ".join(f"`{n}` string" for n in names)
        part = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(same)
        header = part if header is None else header.unionByName(part, allowMissingColumns=True)
    label = F.col("fault")
    have = [f.name for f in schemas.RAW_READINGS.fields if f.name in header.columns]
    return header.select(*have).withColumns(
        {"id": F.col("id").cast("long"), "fault": F.when(~label.isin(*domain.MISSING_TOKENS), label)}
    )


def checked_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every line of a header CSV with what is wrong with it.

    The header's columns as text, ``errors`` (empty where the line is fine) and ``record``, the line as it came or
    its fields joined. ``columns``: more or fewer fields than the header; ``id``: no whole number; ``created_at``: there, but
    no time. Sensors are not judged, as unreadable ones count as zero.
    """
    names = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{n}` string" for n in [*names, "_record"])
    lines = spark.read.schema(schema).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_record").csv(path)
    whole = F.col("_record").isNull()
    time = F.col("created_at")
    checks = [F.when(~whole, "columns"), F.when(whole & F.col("id").try_cast("long").isNull(), "id"), F.when(whole & time.isNotNull() & F.try_to_timestamp(time).isNull(), "created_at")]
    return lines.withColumns(
        {"errors": F.array_compact(F.array(*checks)), "record": F.coalesce("_record", F.concat_ws(",", *[F.coalesce(F.col(n), F.lit("")) for n in names]))}
    ).drop("_record")


def write_checked(spark: SparkSession, path: str, out: str) -> None:
    """Lines of a CSV to ``status=accepted`` and ``status=refused`` under ``out``, in one pass."""
    rows = checked_csv(spark, path)
    status = F.when(F.size("errors") == 0, "accepted").otherwise("refused").alias("status")
    rows.select("*", status).write.mode("overwrite").partitionBy("status").parquet(out)


def accepted_rows(spark: SparkSession, out: str) -> DataFrame:
    """Accepted lines as ``scan_csv`` returns rows, ready for ``preprocess``."""
    rows = spark.read.parquet(out).filter("status = 'accepted'").drop("status", "errors", "record")
    label = F.col("fault")
    return rows.withColumns({"id": F.col("id").cast("long"), "fault": F.when(~label.isin(*domain.MISSING_TOKENS), label)})


def preprocess(raw: DataFrame, strict_time: bool = True) -> DataFrame:
    """Typed, cleaned, labelled readings with engineered features."""
    typed = raw.withColumn("created_at", numeric.timestamp(F.col("created_at"), strict_time))
    cleaned = features.clean_sensors(typed, strict=True)
    return features.add_features(labels.with_category(cleaned))


def write_processed(processed: DataFrame, path: str) -> None:
    """Parquet partitioned by day, time-ordered inside each file.

    Rows are rebalanced by day: days with few rows share a task, and a day with
    very many is split over several.
    """
    (
        processed.withColumn("reading_date", F.to_date("created_at"))
        .hint("rebalance", "reading_date")
        .sortWithinPartitions("reading_date", F.col("created_at").asc_nulls_last(), "id")
        .write.mode("overwrite")
        .partitionBy("reading_date")
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at ``path``, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def load_processed(spark: SparkSession, csv_path: str, cache_path: str) -> DataFrame:
    """Processed readings from the cache, built first when it is missing."""
    cached = read_table(spark, cache_path)
    if cached is None:
        write_processed(preprocess(scan_csv(spark, csv_path)), cache_path)
        cached = spark.read.parquet(cache_path)
    return cached.drop("reading_date")


def ingest(processed: DataFrame, path: str) -> bool:
    """Write the stored table unless it already has as many rows; True if written."""
    spark = processed.sparkSession
    existing = read_table(spark, path)
    if existing is not None and existing.count() >= processed.count():
        return False
    features.stored_projection(processed).write.mode("overwrite").parquet(path)
    return True
