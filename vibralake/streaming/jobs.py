"""Structured Streaming jobs over live sensor events."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vibralake.operators import event_json, features, prescribe
from vibralake.session import PACKED, spread

# What is there is read and the job ends; ``{"processingTime": "10 seconds"}`` keeps it running.
ALL_THERE_IS = {"availableNow": True}


def payload_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """One JSON event per text line."""
    return spark.readStream.options(**options).text(path).withColumnRenamed("value", "payload")


def validated(stream: DataFrame, payload: str = "payload") -> DataFrame:
    return event_json.validate(stream, payload)


def typed_events(validated_stream: DataFrame, defaults: str = "api") -> DataFrame:
    """Accepted events with sensor columns and engineered features."""
    return features.add_features(event_json.sensor_columns(event_json.accepted(validated_stream), defaults))


def write_validated(
    stream: DataFrame, path: str, checkpoint: str, payload: str = "payload", trigger: Mapping = ALL_THERE_IS
) -> StreamingQuery:
    """Route events to ``status=accepted`` and ``status=refused`` under ``path``.

    One pass validates and writes both. Each batch has a folder of its own
    number and overwrites it when it is run again, so a restart after a failure
    leaves no doubles.
    """

    def write(batch: DataFrame, number: int) -> None:
        checked = event_json.validate(spread(batch), payload)
        status = F.when(F.col("is_valid"), "accepted").otherwise("refused").alias("status")
        rows = checked.select(payload, "errors", status)
        rows.write.mode("overwrite").partitionBy("status").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def daily_fault_counts(readings: DataFrame, time: str = "created_at", late: str = "1 day") -> DataFrame:
    """Problem readings per day and category; later than ``late`` is dropped."""
    return (
        readings.withWatermark(time, late)
        .filter("is_problem")
        .groupBy(F.window(time, "1 day"), "fault_category")
        .agg(F.count("*").alias("occurrences"))
        .select(F.to_date("window.start").alias("date"), "fault_category", "occurrences")
    )


def write_daily_counts(
    readings: DataFrame, path: str, checkpoint: str, time: str = "created_at", late: str = "1 day", trigger: Mapping = ALL_THERE_IS
) -> StreamingQuery:
    """Keep daily counts up to date: each batch writes the days that changed, in a folder of its number.

    The state forgets a day once the watermark has passed it; readings that come
    later than ``late`` are dropped.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        daily_fault_counts(readings, time, late)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def read_daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """The latest count of each day and category."""
    written = spark.read.parquet(path)
    return written.groupBy("date", "fault_category").agg(F.max_by("occurrences", "batch").alias("occurrences"))


def write_prescriptions(
    events: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    repeat_window: str | None = None,
    trigger: Mapping = ALL_THERE_IS,
) -> StreamingQuery:
    """Prescribe every micro-batch and append to the log.

    ``answer`` turns a batch of events into ``prescribe.prescribe`` rows, with
    its model, history and manuals bound in. Repeated ids are kept, as in the
    log they come from, unless ``repeat_window`` names a time within which
    they are dropped.
    """
    if repeat_window is not None:
        events = events.withWatermark("created_at", repeat_window).dropDuplicatesWithinWatermark(["id"])

    def write(batch: DataFrame, number: int) -> None:
        rows = prescribe.log_rows(answer(spread(batch)))
        rows.write.options(**PACKED).mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
