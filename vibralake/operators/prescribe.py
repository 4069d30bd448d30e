"""Guarded recommendation per scored event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vibralake import domain, schemas
from vibralake.functions import text as tx
from vibralake.operators import search
from vibralake.session import durable, small_side

ROUTE_NORMAL, ROUTE_MISSING, ROUTE_DOCUMENTED = "normal", "undocumented", "documented"


def document_map(spark, rows=domain.DOCUMENT_MAP) -> DataFrame:
    return spark.createDataFrame(list(rows), schemas.DOCUMENT_MAP)


def availability(categories: DataFrame, registry: DataFrame, mapping: DataFrame, category: str = "fault_category") -> DataFrame:
    """Documentation status per row: the registry decides, then the static map."""
    known = registry.select(
        F.col("fault_category").alias(category),
        F.lit(True).alias("_registered"),
        "document_name",
        F.col("title").alias("_title"),
        "chunk_count",
    )
    static = mapping.select(
        F.col("fault_category").alias(category), "doc_id", F.col("title").alias("_map_title"), "has_document"
    )
    registered = F.coalesce("_registered", F.lit(False))
    return (
        categories.join(small_side(known), category, "left")
        .join(small_side(static), category, "left")
        .withColumns(
            {
                "has_document": registered | F.coalesce("has_document", F.lit(False)),
                "document_name": F.when(registered, F.col("document_name")).otherwise(F.col("doc_id")),
                "title": F.when(registered, F.col("_title")).otherwise(
                    F.coalesce("_map_title", F.lit(domain.NO_DOCUMENT_TITLE))
                ),
                "chunk_count": F.when(registered, F.col("chunk_count")).otherwise(0),
            }
        )
        .drop("_registered", "_title", "_map_title", "doc_id")
    )


def route(category: Column, has_document: Column) -> Column:
    return (
        F.when(category == domain.NORMAL, ROUTE_NORMAL)
        .when(~has_document, ROUTE_MISSING)
        .otherwise(ROUTE_DOCUMENTED)
    )


def retrieval_text(category: Column) -> Column:
    return tx.fill(domain.RETRIEVAL_TEXT, category=category)


def excerpts(
    categories: DataFrame,
    chunks: DataFrame,
    index: search.Index,
    n: int = domain.CONTEXT_CHUNKS,
    pattern: str = search.WORDS,
) -> DataFrame:
    """``(fault_category, excerpts)``: the best chunk texts of each category.

    The query depends on the category alone, so it runs once per category and
    not once per event.
    """
    asked = categories.select("fault_category").distinct().withColumns(
        {"query_text": retrieval_text(F.col("fault_category")), "group": F.col("fault_category")}
    )
    found = search.search(asked, index, n, query_id="fault_category", group="group", pattern=pattern)
    hits = search.with_chunk_text(found.withColumnRenamed("query_id", "_asked"), chunks)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return hits.groupBy(F.col("_asked").alias("fault_category")).agg(
        F.transform(ordered, lambda e: e["text"]).alias("excerpts")
    )


def _shown(name: str, columns: Sequence[str], default: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in columns else F.lit(default)


def sensor_summary(columns: Sequence[str]) -> Column:
    names = ("rpm", "temperature_c", "temperature_f", "z_rms_velocity_mm_s", "x_rms_velocity_mm_s",
             "z_peak_acceleration_g", "x_peak_acceleration_g", "z_kurtosis", "x_kurtosis", "z_crest_factor", "x_crest_factor")
    values = {n: _shown(n, columns, "0.0") for n in names}
    # A caller that numbers its rows keeps the given id under another name.
    id_column = "_given" if "_given" in columns else "id"
    return tx.fill(domain.SENSOR_SUMMARY, id=_shown(id_column, columns, "N/A"), **values)


def history_summary(columns: Sequence[str]) -> Column:
    occurrences = F.coalesce("total_historical_occurrences", F.lit(0)) if "total_historical_occurrences" in columns else F.lit(0)
    return tx.fill(
        domain.HISTORY_SUMMARY,
        similar_count=_shown("similar_count", columns, "0"),
        occurrences=tx.thousands(occurrences),
        avg_rpm=_shown("avg_rpm", columns, "0.0"),
        avg_temp_c=_shown("avg_temp_c", columns, "0.0"),
    )


def context_text(chunks: Column) -> Column:
    return F.array_join(
        F.transform(chunks, lambda c, i: tx.fill(domain.CONTEXT_EXCERPT, number=i + 1, text=c)), "\n\n"
    )


def missing_text(category: Column, confidence: Column, occurrences: Column) -> Column:
    return tx.fill(
        domain.MISSING_TEXT,
        category_title=tx.title_case(category),
        category=category,
        confidence=tx.one_decimal(confidence),
        occurrences=tx.thousands(occurrences),
    )


def synthesis_text(category: Column, confidence: Column, title: Column, sensors: Column, history: Column, chunks: Column) -> Column:
    values = {
        "category_title": tx.title_case(category),
        "category": category,
        "confidence": tx.one_decimal(confidence),
        "title": title,
        "sensor_summary": sensors,
        "history_summary": history,
    }
    head = F.array(*[tx.fill(part, **values) for part in domain.SYNTHESIS_HEAD])

    def excerpt(chunk: Column, i: Column) -> Column:
        shown = tx.strip(F.replace(chunk, F.lit(domain.PAGE_MARK), F.lit(domain.PAGE_MARK_SHOWN)))
        return tx.fill(domain.SYNTHESIS_EXCERPT, number=i + 1, text=shown)

    tail = F.array(*[F.lit(part) for part in domain.SYNTHESIS_TAIL])
    return F.array_join(F.concat(head, F.transform(chunks, excerpt), tail), "\n\n")


def prompt_text(category: Column, confidence: Column, title: Column, sensors: Column, history: Column, chunks: Column) -> Column:
    """The text a language model would be asked; the call itself is not made."""
    return tx.fill(
        domain.PROMPT_TEXT,
        category_upper=tx.upper_case(category),
        confidence=tx.one_decimal(confidence),
        title=title,
        sensor_summary=sensors,
        history_summary=history,
        context=context_text(chunks),
    )


def prescribe(
    events: DataFrame, registry: DataFrame, mapping: DataFrame, texts: DataFrame, prompts: bool = False, kept: Sequence[str] = ()
) -> DataFrame:
    """Result record per event.

    ``events`` has ``id, fault_category`` (the predicted one), ``confidence``
    and, where known, sensor and similarity columns. ``texts`` is the output
    of ``excerpts``. All joined tables have one row per category. ``kept`` names columns of the events that are shown beside the result.
    """
    have = events.columns
    status = availability(events, registry, mapping)
    joined = status.join(small_side(texts), "fault_category", "left")
    c = F.col
    routed = joined.withColumns(
        {
            "route": route(c("fault_category"), c("has_document")),
            "excerpts": F.coalesce("excerpts", F.array().cast("array<string>")),
            "_sensors": sensor_summary(have),
            "_history": history_summary(have),
        }
    )
    occurrences = F.coalesce("total_historical_occurrences", F.lit(0)) if "total_historical_occurrences" in have else F.lit(0)
    documented = c("route") == ROUTE_DOCUMENTED
    arguments = (c("fault_category"), c("confidence"), c("title"), c("_sensors"), c("_history"), c("excerpts"))
    text = (
        F.when(c("route") == ROUTE_NORMAL, F.lit(domain.NORMAL_TEXT))
        .when(c("route") == ROUTE_MISSING, missing_text(c("fault_category"), c("confidence"), occurrences))
        .otherwise(synthesis_text(*arguments))
    )
    extra = [F.when(documented, prompt_text(*arguments)).alias("prompt")] if prompts else []
    return routed.select(
        c("id").alias("event_id"),
        "fault_category",
        "confidence",
        "route",
        documented.alias("has_document"),
        (c("route") == ROUTE_NORMAL).alias("is_operational_normal"),
        text.alias("prescription"),
        F.when(documented, F.array("document_name")).otherwise(F.array().cast("array<string>")).alias("referenced_docs"),
        F.when(documented, F.size("excerpts")).alias("chunks_used"),
        *[c(name) for name in ("similar_count", "raw_event_json") if name in have],
        *extra,
        *[c(name) for name in kept],
    )


def log_rows(prescriptions: DataFrame, raw_json: Column | None = None) -> DataFrame:
    """Rows of the prescription history; every run adds its own.

    The event as it came is ``raw_json``, or the column ``raw_event_json`` where the rows carry it.
    """
    if raw_json is None and "raw_event_json" in prescriptions.columns:
        raw_json = F.col("raw_event_json")
    similar = c if (c := "similar_count") in prescriptions.columns else None
    return prescriptions.select(
        "event_id",
        "fault_category",
        "confidence",
        (F.coalesce(similar, F.lit(0)) if similar else F.lit(0)).cast("int").alias("similar_count"),
        F.col("prescription").alias("prescription_text"),
        "has_document",
        (F.lit(None).cast("string") if raw_json is None else raw_json).alias("raw_event_json"),
        F.current_timestamp().alias("created_at"),
    )
