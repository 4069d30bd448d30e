"""The whole batch job: readings and manuals in, prescriptions out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vibralake import domain
from vibralake.operators import classifier, documents, event_json, features, prescribe, scaling, search, similarity
from vibralake.session import PACKED, discard, durable, written
from vibralake.sources import readings as readings_source
from vibralake.sources import tables


class Knowledge(NamedTuple):
    """What events are answered with; all of it is stored or small."""

    model: classifier.Model
    history: DataFrame
    scale: scaling.Scale
    registry: DataFrame
    mapping: DataFrame
    texts: DataFrame


def history_rows(processed: DataFrame) -> DataFrame:
    """Processed readings with their feature row as one array."""
    return processed.select(
        "id", "created_at", "fault", "fault_category", "rpm", "temperature_c", "z_rms_velocity_mm_s",
        "x_rms_velocity_mm_s", features.feature_array().alias("features"),
    )


def store_history(processed: DataFrame, path: str) -> None:
    """Write the history as one column a sensor: these pack better than feature arrays, and what follows from them is not stored."""
    rows = processed.select("id", "created_at", "fault", "fault_category", *domain.SENSORS)
    rows.write.options(**PACKED).mode("overwrite").parquet(path)


def stored_history(spark: SparkSession, path: str) -> DataFrame:
    """The history that ``store_history`` wrote, as ``history_rows``; a folder that holds such rows is read as it is."""
    rows = spark.read.parquet(path)
    return rows if "features" in rows.columns else history_rows(features.add_features(rows))


def build(
    spark: SparkSession,
    csv_path: str,
    pages: DataFrame,
    folder: str,
    forest: classifier.Forest = classifier.Forest(),
) -> Knowledge:
    """Ingest readings, train and measure, index the manuals; all under ``folder``."""
    processed = readings_source.load_processed(spark, csv_path, f"{folder}/processed")
    readings_source.ingest(processed, f"{folder}/sensor_readings")
    model, record = classifier.train_and_evaluate(processed, forest=forest)
    classifier.save(model, f"{folder}/model")
    tables.write_json(record, f"{folder}/evaluation")
    store_history(processed, f"{folder}/history")
    index_manuals(spark, pages, folder)
    return load(spark, folder)


def index_manuals(spark: SparkSession, pages: DataFrame, folder: str) -> None:
    """Manuals to texts, registry and chunk collection."""
    mapping = prescribe.document_map(spark)
    texts = durable(documents.with_chunks(documents.assemble(documents.route_pages(pages))))
    tables.write_texts(texts, f"{folder}/texts")
    matched = documents.fan_out(documents.named_documents(texts, mapping))
    documents.registry_rows(matched).write.mode("overwrite").parquet(f"{folder}/fault_documents")
    documents.index_rows(matched).write.mode("overwrite").parquet(f"{folder}/chunks")
    summary = documents.document_summary(texts, mapping)
    tables.write_json(summary, f"{folder}/document_summary")


def load(spark: SparkSession, folder: str) -> Knowledge:
    """Stored results as ``Knowledge``; excerpts are retrieved once per category."""
    history = stored_history(spark, f"{folder}/history")
    registry = spark.read.parquet(f"{folder}/fault_documents")
    chunks = spark.read.parquet(f"{folder}/chunks")
    index = search.build_index(chunks, group="fault_category")
    texts = durable(prescribe.excerpts(registry, chunks, index))
    discard(index.shards, index.terms)
    return Knowledge(
        classifier.load(f"{folder}/model"),
        history,
        scaling.fit_array(history, "features"),
        registry,
        prescribe.document_map(spark),
        texts,
    )


def answer(events: DataFrame, known: Knowledge, k: int = domain.SIMILAR_TOP_K, **options) -> DataFrame:
    """Classify, find similar readings and prescribe, one row per event.

    ``events`` has ``id`` and the feature columns. An id may be missing or
    repeated, so rows are told apart by a number of their own.
    """
    kept = [c for c in events.columns if c not in ("fault", "fault_category", "is_problem")]
    # files hold no column without a type; the JSON text is some times the size of what it is made from
    plain = [F.col(c).cast("string").alias(c) if kind == "void" else F.col(c) for c, kind in events.select(*kept).dtypes]
    numbered = written(events.select(*plain).withColumn("_event", F.monotonically_increasing_id()), "events", **PACKED)
    numbered = numbered.withColumn("raw_event_json", event_json.to_json(*kept))
    scored = classifier.score(known.model, numbered).withColumnRenamed("predicted_category", "fault_category")
    asked = numbered.select(F.col("_event").alias("id"), features.feature_array().alias("features"))
    found = similarity.similar_events(asked, known.history, k, scale=known.scale, **options).withColumnRenamed("query_id", "_event")
    joined = scored.join(found, "_event").withColumnsRenamed({"id": "_given", "_event": "id"})
    shown = (
        "_given", "probabilities", "top_probabilities", "top_matches", "time_distribution",
        "total_historical_occurrences", "avg_rpm", "min_rpm", "max_rpm", "avg_temp_c", "min_temp_c", "max_temp_c",
        "avg_z_rms_velocity", "avg_x_rms_velocity", "primary_historical_fault", "events_per_active_day", "first_seen", "last_seen",
    )
    # an event's rows meet once; what is shown goes through the texts with it, and what is not asked for is never made
    rows = prescribe.prescribe(joined, known.registry, known.mapping, known.texts, kept=shown)
    return rows.withColumn("event_id", F.col("_given")).drop("_given")
