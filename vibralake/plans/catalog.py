"""Registered queries: every operator on whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vibralake import domain
from vibralake.functions import arrays, labels, numeric
from vibralake.functions import text as tx
from vibralake.operators import (
    chat,
    classifier,
    dashboard,
    documents,
    evaluation,
    event_json,
    features,
    prescribe,
    scaling,
    search,
    similarity,
    similarity_index,
    split,
    upsert,
)
from vibralake.plans import pipeline
from vibralake.plans import tables as t
from vibralake.session import PACKED, discard, durable, scratch_dir, small_side, written
from vibralake.sources import pages as pages_source
from vibralake.sources import readings as readings_source
from vibralake.sources import tables as table_source
from vibralake.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


# --- labels and dashboard -------------------------------------------------


@query
def label_category_map(spark, d):
    counts = labels.label_counts(t.raw_readings(t.table(spark, d, "events")))
    return counts.select("fault", "fault_category", "is_problem", labels.is_operational(F.col("fault_category")).alias("is_operational"), "n")


@query
def category_distribution(spark, d):
    return dashboard.distribution_of_labels(labels.label_counts(t.raw_readings(t.table(spark, d, "events"))))


@query
def category_value_counts(spark, d):
    return dashboard.value_counts(t.readings(t.table(spark, d, "events")))


@query
def problem_ranking(spark, d):
    return dashboard.problem_ranking(dashboard.category_distribution(t.readings(t.table(spark, d, "events"))))


@query
def kpi_summary(spark, d):
    registry = t.registry_winners(t.table(spark, d, "documents"), t.manual_map(spark))
    answered = t.table(spark, d, "conversations").filter("role = 'assistant'")
    found = dashboard.kpis(t.readings(t.table(spark, d, "events")), registry, answered)
    return found.withColumn("normal_ratio", F.round("normal_ratio", 4))


@query
def daily_fault_timeline(spark, d):
    found = dashboard.daily_timeline(t.readings(t.table(spark, d, "events")))
    return found.withColumn("date", _day("date"))


@query
def category_recurrence(spark, d):
    found = dashboard.recurrence(dashboard.daily_counts(t.readings(t.table(spark, d, "events"))))
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("first_seen", "last_seen")})


@query
def category_date_histogram(spark, d):
    found = dashboard.date_histogram(dashboard.daily_counts(t.readings(t.table(spark, d, "events"))))
    days = found.select("fault_category", F.explode("time_distribution").alias("date", "occurrences"))
    return days.withColumn("date", _day("date"))


# --- cleaning and features ------------------------------------------------


@query
def numeric_coercion(spark, d):
    value = numeric.number_or_zero(F.col("raw"))
    return t.text_numbers(t.table(spark, d, "events")).select(
        "event_id", value.alias("number"), numeric.finite_or_zero(value).alias("finite")
    )


@query
def ratio_energy_features(spark, d):
    found = features.add_features(features.clean_sensors(t.line_sensors(t.spread_table(spark, d, "lineitem"))))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(c, 6).alias(c) for c in domain.ENGINEERED])


def _line_features(spark, d) -> DataFrame:
    return features.add_features(t.line_sensors(t.spread_table(spark, d, "lineitem")))


@query
def scaler_stats(spark, d):
    found = scaling.column_stats(_line_features(spark, d), domain.FEATURES)
    return found.select("feature", *[F.round(c, 4).alias(c) for c in ("mean", "std", "scale")])


@query
def standardized_features(spark, d):
    rows = _line_features(spark, d)
    shown = ("rpm", "temperature_c", *domain.ENGINEERED)
    # Means come from the table itself, so the columns are read twice: once for
    # the statistics, once for the projection that uses them as constants.
    scaled = scaling.standardise(rows, shown, scaling.fit_columns(rows, shown))
    return scaled.select("l_orderkey", "l_linenumber", "l_partkey", *[(F.round(c, 4) + 0.0).alias(c) for c in shown])


@query
def stored_readings(spark, d):
    """Build the stored table, write it through the count guard and read it back."""
    rows = features.add_features(t.readings(t.spread_table(spark, d, "events"), domain.SENSORS))
    path = scratch_dir(spark, "readings")
    readings_source.ingest(rows, path)
    return spark.read.parquet(path).select(
        "id", "created_at", "fault", "fault_category", "is_problem", F.round("total_vibration_energy", 4).alias("total_vibration_energy")
    )


@query
def time_sorted_readings(spark, d):
    rows = features.time_sorted(t.readings(t.table(spark, d, "events")))
    return rows.select("id", F.date_format("created_at", "yyyy-MM-dd").alias("day"), "fault_category")


@query
def display_formats(spark, d):
    counts = dashboard.value_counts(t.readings(t.table(spark, d, "events")))
    c = F.col("fault_category")
    return counts.select(
        c.alias("category"), tx.title_case(c).alias("title"), tx.upper_case(c).alias("upper"), tx.thousands(F.col("count") * 1000).alias("shown")
    )


# --- JSON events ----------------------------------------------------------


@query
def event_validation(spark, d):
    checked = t.validated_payloads(t.spread_table(spark, d, "events"))
    return checked.select("event_id", "is_valid", F.array_join("errors", ",").alias("errors"))


@query
def event_json_fields(spark, d):
    shown = ("rpm", "temperature_c", "temperature_f", "z_peak_velocity_mm_s", "z_kurtosis")
    checked = event_json.accepted(t.validated_payloads(t.spread_table(spark, d, "events")))
    api = event_json.sensor_columns(checked, "api").select("event_id", "id", *shown)
    zero = event_json.sensor_columns(checked, "zero").select("event_id", "id", *shown)
    return api.withColumn("mode", F.lit("api")).unionByName(zero.withColumn("mode", F.lit("zero")))


# --- similarity -----------------------------------------------------------


def _history(spark, d) -> DataFrame:
    return t.history(t.table(spark, d, "embeddings"), t.table(spark, d, "events"))


def _neighbours(spark, d) -> DataFrame:
    vectors = t.spread_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    return similarity.nearest(vectors, vectors)


@query
def similarity_topk(spark, d):
    return _neighbours(spark, d)


@query
def similarity_topk_cells(spark, d):
    """The same neighbours by the plan for many queries, whatever their number."""
    vectors = t.spread_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    return similarity.nearest(vectors, vectors, few=0)


@query
def similarity_index_topk(spark, d):
    """The same neighbours from a stored index, built and loaded again."""
    vectors = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    path = scratch_dir(spark, "similarity-index")
    similarity_index.build(vectors, path)
    return similarity_index.search(vectors, similarity_index.load(spark, path))


@query
def vector_search_by_label(spark, d):
    """Every vector against the vectors of its label."""
    rows = t.table(spark, d, "embeddings")
    asked = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    stored = rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")
    found = similarity.by_vector(asked, stored, domain.CONTEXT_CHUNKS, "label")
    return found.select("query_id", "item_id", "score", "rank")


@query
def similarity_context(spark, d):
    return similarity.operational_context(similarity.with_rows(_neighbours(spark, d), _history(spark, d)))


@query
def similarity_matches(spark, d):
    shown = similarity.match_list(similarity.with_rows(_neighbours(spark, d), _history(spark, d)), domain.SHOWN_MATCHES)
    return shown.select("query_id", F.inline("top_matches")).select(
        "query_id", "rank", "id", "similarity_score", F.col("fault").alias("original_label"), F.round("rpm", 4).alias("rpm")
    )


def _with_context(spark, d) -> DataFrame:
    context = similarity.operational_context(similarity.with_rows(_neighbours(spark, d), _history(spark, d)))
    # totals count every reading, those without a vector too
    return similarity.category_totals(context, t.readings(t.table(spark, d, "events")))


@query
def similarity_category_total(spark, d):
    return _with_context(spark, d).select("query_id", "match_category", "total_historical_occurrences", "events_per_active_day")


# --- split, weights, metrics ----------------------------------------------


@query
def stratified_split(spark, d):
    rows = t.readings(t.table(spark, d, "events")).select("id", "fault_category")
    return split.stratified_split(rows, "fault_category", "id")


@query
def class_weights(spark, d):
    found = split.class_weights(t.readings(t.table(spark, d, "events")), "fault_category")
    return found.withColumn("weight", F.round("weight", 6))


def _pairs(spark, d) -> DataFrame:
    rows = t.table(spark, d, "embeddings").select("label", (F.col("vec_id") % 10).cast("int").alias("prediction"))
    return evaluation.pair_counts(rows)


@query
def confusion_matrix(spark, d):
    return evaluation.confusion_matrix(_pairs(spark, d))


@query
def label_confusion(spark, d):
    """Quality against toxicity of the labelled documents."""
    rows = t.table(spark, d, "labels")
    return evaluation.confusion_matrix(evaluation.pair_counts(rows, "quality", "toxic"))


@query
def class_report(spark, d):
    return evaluation.class_report(_pairs(spark, d)).select(
        "class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


@query
def metric_summary(spark, d):
    found = evaluation.metric_summary(evaluation.class_report(_pairs(spark, d)))
    return found.select(*[c if c == "support" else F.round(c, 6).alias(c) for c in found.columns])


# --- probabilities --------------------------------------------------------


@query
def argmax_confidence(spark, d):
    rows = t.scored(t.table(spark, d, "embeddings"))
    return rows.select("vec_id", "fault_category", F.round("confidence", 6).alias("confidence"))


@query
def top_probabilities(spark, d):
    names = F.array(*[F.lit(c) for c in t.CLASSES])
    top = arrays.top_probabilities(names, F.col("p"), domain.SHOWN_PROBABILITIES)
    return t.scored(t.table(spark, d, "embeddings")).select("vec_id", F.posexplode(top).alias("position", "e")).select(
        "vec_id", "position", F.col("e.label").alias("category"), F.col("e.probability").alias("percent")
    )


@query
def probability_map(spark, d):
    names = F.array(*[F.lit(c) for c in t.CLASSES])
    rows = t.scored(t.table(spark, d, "embeddings"))
    return rows.select("vec_id", F.explode(arrays.probability_map(names, F.col("p"))).alias("category", "percent"))


# --- documents ------------------------------------------------------------


@query
def page_routing(spark, d):
    routed = documents.route_pages(t.conversation_pages(t.table(spark, d, "conversations")))
    return routed.select("doc_name", "page_idx", "is_ocr", "text")


@query
def document_assembly(spark, d):
    return documents.assemble(documents.route_pages(t.conversation_pages(t.table(spark, d, "conversations"))))


@query
def document_chunks(spark, d):
    return t.document_chunks(t.spread_table(spark, d, "documents")).select("doc_id", "chunk_index", "text")


@query
def document_summary(spark, d):
    found = documents.document_summary(t.manuals(t.spread_table(spark, d, "documents")), t.manual_map(spark), key="source")
    return found.withColumn("categories", F.array_join("categories", ","))


@query
def chunk_index(spark, d):
    matched = t.matched_manuals(t.spread_table(spark, d, "documents"), t.manual_map(spark))
    return documents.index_rows(matched)


@query
def document_registry(spark, d):
    """The registry of the oldest manuals, brought up to date with the newest."""
    rows, mapping = t.spread_table(spark, d, "documents"), t.manual_map(spark)
    found = documents.upsert_registry(t.registry(rows, mapping, newest=False), t.registry(rows, mapping))
    return found.select("fault_category", "document_name", "title", "text_content", "chunk_count")


@query
def chunk_upsert(spark, d):
    """Chunks in lower case put over the collection, for every second manual as a re-upload."""
    rows = documents.index_rows(t.matched_manuals(t.spread_table(spark, d, "documents"), t.manual_map(spark)))
    renewed = rows.filter("chunk_index % 2 = 0").withColumn("text", F.lower("text"))
    return documents.upsert_chunks(rows, renewed).select("chunk_id", "text")


@query
def chunk_upsert_stored(spark, d):
    """The same on a stored collection, of which only the folders that get chunks are written again."""
    rows = documents.index_rows(t.matched_manuals(t.spread_table(spark, d, "documents"), t.manual_map(spark)))
    path = scratch_dir(spark, "collection")
    upsert.write_keyed(rows, path, ["chunk_id"])
    renewed = upsert.read_keyed(spark, path).filter("chunk_index % 2 = 0").withColumn("text", F.lower("text"))
    upsert.upsert_keyed(spark, path, renewed, ["chunk_id"], ["text"])
    return upsert.read_keyed(spark, path).select("chunk_id", "text")


@query
def document_ingest(spark, d):
    """Conversations uploaded as manuals: pages to registry, chunks and counts."""
    pages = t.conversation_pages(t.table(spark, d, "conversations")).withColumns(
        {"fault_category": F.lit(domain.OTHER_FAULT), "title": F.concat(F.lit("Manual "), F.col("doc_name"))}
    )
    _, _, counts = documents.ingest_documents(pages, separator="\n")
    return counts


@query
def latest_upsert(spark, d):
    """Newest event per user."""
    found = upsert.latest_per_key(t.table(spark, d, "events"), ["user_id"], ["ts", "event_id"])
    return found.select("user_id", "event_id", "event_type", "value")


# --- search ---------------------------------------------------------------


@query
def chunk_search(spark, d):
    """Every benchmark passage as a query against all chunks of all documents."""
    chunks = written(t.document_chunks(t.spread_table(spark, d, "documents")), "chunks")
    index = search.build_index(chunks)
    asked = t.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    found = search.search(asked, index)
    return found.select("query_id", "rank", F.col("item_id").alias("chunk_id"), F.round("score", 3).alias("score"))


@query
def chunk_search_by_language(spark, d):
    """The same with a metadata filter: each passage asks one language only."""
    chunks = written(t.document_chunks(t.spread_table(spark, d, "documents")), "chunks")
    index = search.build_index(chunks, group="lang")
    pick = F.element_at(F.array(*[F.lit(x) for x in t.LANGUAGES]), (F.col("item_id") % len(t.LANGUAGES) + 1).cast("int"))
    asked = t.table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), pick.alias("lang")
    )
    found = search.search(asked, index, group="lang")
    return found.select("query_id", "rank", F.col("item_id").alias("chunk_id"), F.round("score", 3).alias("score"))


# --- prescription ---------------------------------------------------------


@query
def document_availability(spark, d):
    rows = t.scored(t.table(spark, d, "embeddings")).select("vec_id", "fault_category")
    mapping = prescribe.document_map(spark)
    found = prescribe.availability(rows, t.registry(t.spread_table(spark, d, "documents"), t.manual_map(spark)), mapping)
    return found.select("vec_id", "fault_category", "has_document", "document_name", "title", "chunk_count")


@query
def guardrail_route(spark, d):
    found = document_availability(spark, d)
    return found.select("vec_id", prescribe.route(F.col("fault_category"), F.col("has_document")).alias("route"))


def _manual_texts(spark, d) -> DataFrame:
    """Best excerpts per documented category."""
    chunks = written(documents.index_rows(t.matched_manuals(t.spread_table(spark, d, "documents"), t.manual_map(spark))), "chunks", **PACKED)
    index = search.build_index(chunks, group="fault_category")
    categories = chunks.select("fault_category").distinct()
    texts = durable(prescribe.excerpts(categories, chunks, index))
    discard(index.shards, index.terms, chunks)
    return texts


SHOWN_SENSORS = (
    "rpm", "temperature_c", "temperature_f", "z_rms_velocity_mm_s", "x_rms_velocity_mm_s", "z_peak_acceleration_g",
    "x_peak_acceleration_g", "z_kurtosis", "x_kurtosis", "z_crest_factor", "x_crest_factor",
)


def _scored_events(spark, d) -> DataFrame:
    """Scored events with rounded sensor values and the context of their neighbours."""
    sensors = t.readings(t.table(spark, d, "events"), SHOWN_SENSORS).select("id", *[F.round(c, 3).alias(c) for c in SHOWN_SENSORS])
    scored = t.scored(t.table(spark, d, "embeddings")).select(F.col("vec_id").alias("id"), "fault_category", "confidence")
    context = _with_context(spark, d).select(
        F.col("query_id").alias("id"), "similar_count", "avg_rpm", "avg_temp_c", "total_historical_occurrences"
    )
    return scored.join(sensors, "id").join(context, "id")


def _prescriptions(spark, d, events: DataFrame) -> DataFrame:
    mapping = prescribe.document_map(spark)
    registry = t.registry(t.spread_table(spark, d, "documents"), t.manual_map(spark))
    return prescribe.prescribe(events, registry, mapping, _manual_texts(spark, d), prompts=True)


@query
def prescription_text(spark, d):
    found = _prescriptions(spark, d, _scored_events(spark, d))
    return found.select(
        "event_id", "fault_category", "route", "has_document", "is_operational_normal", "prescription",
        F.array_join("referenced_docs", ",").alias("referenced_docs"),
        F.coalesce("chunks_used", F.lit(0)).alias("chunks_used"), F.coalesce("prompt", F.lit("")).alias("prompt"),
    )


@query
def category_excerpts(spark, d):
    return _manual_texts(spark, d).select("fault_category", prescribe.context_text(F.col("excerpts")).alias("context"))


# --- chat -----------------------------------------------------------------


def _messages(spark, d) -> DataFrame:
    return t.table(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("message")
    )


@query
def chat_context_window(spark, d):
    return chat.recent_messages(_messages(spark, d))


@query
def chat_prompts(spark, d):
    """Each session's last message as a request, with every other one about an event."""
    messages = _messages(spark, d)
    last = upsert.latest_per_key(messages, ["session_id"], ["turn"])
    about = F.col("session_id") % 2 == 0
    asked = last.withColumns(
        {"has_context": about, "fault_category": F.when(about, "polia"), "confidence": F.when(about, F.lit(95.5))}
    )
    found = chat.prompts(asked, chat.recent_messages(messages))
    return found.select("session_id", "prompt", F.size("history").alias("turns"), F.array_join(F.transform("history", lambda h: h["role"]), ",").alias("roles"))


@query
def chat_log_rows(spark, d):
    """Turns with their answers as two log rows each."""
    pairs = _messages(spark, d).filter("role = 'user'").withColumns({"response": F.concat(F.lit("Re: "), "message"), "event_context": F.lit(None).cast("string")})
    return chat.log_rows(pairs).drop("timestamp", "event_context")


# --- forest ---------------------------------------------------------------


def _vector_columns(spark, d) -> tuple[DataFrame, list[str]]:
    names = [f"f{i}" for i in range(64)]
    rows = t.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"),
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)],
        F.concat(F.lit("class_"), F.col("label").cast("string")).alias("fault_category"),
    )
    return rows, names


@query
def forest_train_score(spark, d):
    """What is determined about a fitted forest: which rows are scored, and the form of the scores.

    The labels of the given vectors are independent of the vectors, so no
    accuracy can be asked for here; see the tests.
    """
    rows, names = _vector_columns(spark, d)
    marked = split.stratified_split(rows, "fault_category", "id")
    model = classifier.train(marked.filter("not is_test"), names)
    scored = durable(classifier.score(model, marked.filter("is_test")))
    total = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, x: a + x)
    return scored.select(
        "id",
        "fault_category",
        F.col("predicted_category").isin(*classifier.classes(model)).alias("class_known"),
        F.col("confidence").between(0.0, 100.0).alias("confidence_in_range"),
        (F.abs(total - 100.0) < 0.1).alias("sums_to_100"),
    )


def _graded(spark, d) -> DataFrame:
    """The events whose reading has a label, each for training or for the test."""
    return t.graded_split(t.table(spark, d, "events"))


def _train_rows(marked: DataFrame) -> DataFrame:
    return t.graded(marked.filter("not is_test")).withColumn("is_test", F.lit(False))


@query
def model_evaluation(spark, d):
    """A forest fitted, measured on the test part, and its record as the metrics file holds it."""
    rows = t.graded(t.table(spark, d, "events")).filter("fault is not null")
    _, record = classifier.train_and_evaluate(rows)
    path = scratch_dir(spark, "evaluation")
    table_source.write_json(record, path)
    stored = spark.read.json(path)
    cells = F.array_sort(F.transform("confusion_matrix", lambda x: F.concat_ws(":", x["label"], x["prediction"], x["n"].cast("string"))))
    return stored.select(
        *[F.round(m, 6).alias(m) for m in ("accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted")],
        "test_samples", "total_samples", F.array_join("classes", ",").alias("classes"), F.array_join(cells, ",").alias("confusion_matrix"),
        F.size("top_features").alias("top_features"),
    )


@query
def feature_importance(spark, d):
    """The ten features that a forest draws most on."""
    model = classifier.train(_train_rows(_graded(spark, d)), forest=classifier.Forest(trees=20))
    return classifier.importance_frame(spark, model)


def _knowledge(spark, d, marked: DataFrame) -> pipeline.Knowledge:
    """What events are answered with: a stored model, the history of the train rows, manuals and excerpts."""
    # the manuals come first: nothing of the history lies on disk yet while they are indexed
    registry = durable(t.registry(t.spread_table(spark, d, "documents"), t.manual_map(spark)))
    texts = _manual_texts(spark, d)
    history = _train_rows(marked)
    folder = scratch_dir(spark, "knowledge")
    classifier.save(classifier.train(history), f"{folder}/model")
    pipeline.store_history(history, f"{folder}/history")
    stored = pipeline.stored_history(spark, f"{folder}/history")
    return pipeline.Knowledge(
        classifier.load(f"{folder}/model"), stored, scaling.fit_array(stored, "features"), registry, prescribe.document_map(spark), texts
    )


@query
def event_prescriptions(spark, d):
    """Events from features to recommendation: forest, similar readings, manuals."""
    marked = _graded(spark, d)
    answers = pipeline.answer(t.graded(marked.filter("is_test")), _knowledge(spark, d, marked))
    best = F.element_at("top_matches", 1)
    return answers.select(
        "event_id", "fault_category", "route", "has_document", F.coalesce("chunks_used", F.lit(0)).alias("chunks_used"), "similar_count",
        best["id"].alias("best_match"), best["similarity_score"].alias("best_score"), "total_historical_occurrences", "avg_rpm",
        "primary_historical_fault",
    )


# --- sources and sinks ----------------------------------------------------


@query
def csv_scan(spark, d):
    """Events written as CSV with a header and scanned back: text, missing labels, numbers and times."""
    raw = t.raw_readings(t.table(spark, d, "events"), ("rpm",))
    path = scratch_dir(spark, "csv")
    raw.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).write.options(
        header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    back = readings_source.scan_csv(spark, path)
    return back.select(
        "id", F.date_format(numeric.timestamp(F.col("created_at")), "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        numeric.number_or_zero(F.col("rpm")).alias("rpm"), "fault",
    )


@query
def csv_quarantine(spark, d):
    """Events as CSV lines, some of them broken: which are accepted and why the others are not."""
    path, out = scratch_dir(spark, "lines"), scratch_dir(spark, "checked")
    lines = t.csv_lines(t.table(spark, d, "events"))
    lines.write.options(header=True, sep="|", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    readings_source.write_checked(spark, path, out)
    rows = spark.read.parquet(out)
    return rows.select(F.split("record", ",")[0].alias("given_id"), "status", F.array_join("errors", ",").alias("errors"), "fault")


@query
def processed_cache(spark, d):
    """Readings written to the cache by day and read back."""
    path = scratch_dir(spark, "processed")
    readings_source.write_processed(t.readings(t.table(spark, d, "events"), ("rpm",)), path)
    found = readings_source.read_table(spark, path)
    return found.select("id", "fault_category", _day("created_at").alias("day"), (F.to_date("created_at") == F.col("reading_date")).alias("in_its_day"))


@query
def cached_readings(spark, d):
    """Readings from CSV through the cache: built by the first call, read by the second, which is given no CSV."""
    raw = t.raw_readings(t.table(spark, d, "events"), domain.SENSORS)
    path, cache = scratch_dir(spark, "raw"), scratch_dir(spark, "cache")
    raw.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).write.options(
        header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    readings_source.load_processed(spark, path, cache)
    again = readings_source.load_processed(spark, f"{path}/gone", cache)
    return again.select("id", "fault_category", "is_problem", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query
def stored_texts(spark, d):
    """One text per document stem, written and read back."""
    path = scratch_dir(spark, "texts")
    table_source.write_texts(t.named(t.table(spark, d, "documents")), path)
    return spark.read.parquet(path).select("stem", F.length("text").alias("length"), F.md5("text").alias("digest"))


@query
def page_source(spark, d):
    """Pages written to files and discovered by name."""
    path = scratch_dir(spark, "pages")
    t.conversation_pages(t.table(spark, d, "conversations")).write.parquet(path)
    found = pages_source.read_pages(spark, path)
    return found.select("doc_name", "page_idx", F.length("digital_text").alias("digital"), F.length("ocr_text").alias("ocr"))


@query
def event_json_text(spark, d):
    """Events as JSON text."""
    rows = t.table(spark, d, "events").select("event_id", "event_type", F.lit(None).cast("string").alias("fault"))
    return rows.select("event_id", event_json.to_json("event_id", "event_type", "fault").alias("payload"))


@query
def window_chunks(spark, d):
    """Texts without a paragraph, which are cut by length: all characters blanked."""
    blank = t.table(spark, d, "documents").select("doc_id", F.repeat(F.lit(" "), F.length("text")).alias("text"))
    cut = documents.with_chunks(blank).withColumn("lengths", F.transform("chunks", F.length))
    return cut.select("doc_id", F.size("lengths").alias("chunks"), F.try_element_at("lengths", F.lit(1)).alias("first"), F.try_element_at("lengths", F.lit(-1)).alias("last"))


# --- streaming ------------------------------------------------------------


def _event_stream(spark, d) -> DataFrame:
    static = t.table(spark, d, "events")
    return spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query
def stream_daily_counts(spark, d):
    """Daily problem counts kept by a stream that has read all events."""
    path = scratch_dir(spark, "daily")
    jobs.write_daily_counts(t.readings(_event_stream(spark, d)), path, scratch_dir(spark, "daily-state")).awaitTermination()
    return jobs.read_daily_counts(spark, path).withColumn("date", _day("date"))


@query
def stream_validated_events(spark, d):
    """Accepted and refused events as written by the validating stream."""
    path = scratch_dir(spark, "validated")
    stream = t.payloads(_event_stream(spark, d)).select("payload")
    jobs.write_validated(stream, path, scratch_dir(spark, "validate-state")).awaitTermination()
    return spark.read.parquet(path).select("payload", "status")


@query
def stream_prescriptions(spark, d):
    """Prescription log as written by the prescribing stream."""
    events = _event_stream(spark, d)
    registry = durable(t.registry(t.spread_table(spark, d, "documents"), t.manual_map(spark)))
    mapping, texts = prescribe.document_map(spark), _manual_texts(spark, d)

    def answer(batch: DataFrame) -> DataFrame:
        sensors = [F.round(c, 3).alias(c) for c in SHOWN_SENSORS]
        raw = t.payloads(batch).select(F.col("event_id").alias("id"), F.col("payload").alias("raw_event_json"))
        scored = t.readings(batch, SHOWN_SENSORS).select("id", "fault_category", F.lit(90.0).alias("confidence"), *sensors)
        scored = scored.join(raw, "id")
        return prescribe.prescribe(scored, registry, mapping, texts)

    path = scratch_dir(spark, "prescriptions")
    jobs.write_prescriptions(events, answer, path, scratch_dir(spark, "prescribe-state")).awaitTermination()
    log = table_source.read_or_empty(spark, path, "event_id long")
    return log.select(
        "event_id", "fault_category", "has_document", F.length("prescription_text").alias("text_length"),
        F.length("raw_event_json").alias("raw_length"),
    )


@query
def stream_scored_prescriptions(spark, d):
    """The prescribing stream with a stored model and the stored history: what the log has of each event."""
    marked = _graded(spark, d)
    known = _knowledge(spark, d, marked)
    asked = marked.filter("is_test").select("event_id")

    def answer(batch: DataFrame) -> DataFrame:
        # events meet the ids before they become readings, which are ten times as wide
        return pipeline.answer(t.graded(batch.join(small_side(asked), "event_id")), known)

    path = scratch_dir(spark, "scored")
    jobs.write_prescriptions(_event_stream(spark, d), answer, path, scratch_dir(spark, "scored-state")).awaitTermination()
    log = table_source.read_or_empty(spark, path, "event_id long")
    return log.select("event_id", "fault_category", "has_document", "similar_count", (F.length("raw_event_json") > 0).alias("has_event"))


@query
def stream_deduplicated_log(spark, d):
    """Events that come twice, the second time after the stream was stopped and started again: logged once."""
    incoming, path, state = scratch_dir(spark, "incoming"), scratch_dir(spark, "deduplicated"), scratch_dir(spark, "deduplicated-state")
    registry = durable(t.registry(t.spread_table(spark, d, "documents"), t.manual_map(spark)))
    mapping, texts = prescribe.document_map(spark), _manual_texts(spark, d)
    events = t.table(spark, d, "events")

    def answer(batch: DataFrame) -> DataFrame:
        return prescribe.prescribe(batch.withColumn("confidence", F.lit(100.0)), registry, mapping, texts)

    for _ in range(2):
        events.write.mode("append").parquet(incoming)
        readings = t.readings(spark.readStream.schema(events.schema).parquet(incoming))
        jobs.write_prescriptions(readings.select("id", "created_at", "fault_category"), answer, path, state, repeat_window="40 days").awaitTermination()
    return spark.read.parquet(path).select("event_id", "fault_category", "has_document")
