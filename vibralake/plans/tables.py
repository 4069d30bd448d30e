"""The generic test tables seen as maintenance data.

Each function derives one domain table from whole input tables. Expressions
that the check SQL shares are kept as text both engines read alike: doubles in
exponent form, no implicit decimals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vibralake import domain
from vibralake.functions import arrays, labels
from vibralake.operators import documents as docs
from vibralake.operators import event_json
from vibralake.operators.features import add_features
from vibralake.operators.split import stratified_split
from vibralake.operators.upsert import latest_per_key
from vibralake.session import PACKED, small_side, spread, written



def raw_label(number: int, text: str) -> str:
    """A known label or fragment the way people type it: as it is, padded, in capitals, with more around it."""
    return (text, f" {text}\t", text.upper(), f"{text}_b{number}", f"sala {number} {text} x")[number % 5]


# Raw labels that stand behind the numeric property of an event: every rule and every state once, and some without a rule.
RAW_LABELS = (
    *(raw_label(i, fragment) for i, (fragment, _) in enumerate(reversed(domain.CATEGORY_RULES))),
    *(raw_label(2 * i, state) for i, state in enumerate(reversed(domain.OPERATIONAL_STATES))),
    "", None, "sem leitura", "ruído 7", "NEW_TES_Q",
)

# Classes of the probability vector, alphabetical.
CLASSES = tuple(sorted({c for _, c in domain.CATEGORY_RULES} | {domain.OTHER_FAULT}))

# Document sources that hold a manual: the first six as in the catalogue, the
# others give further manuals to the same categories. src0 and src18 on have none.
MANUAL_SOURCES = tuple(
    (c, d.replace("Doc", "src").replace(".pdf", ""), t, True) for c, d, t, has in domain.DOCUMENT_MAP if has
) + tuple(
    (c, f"src{7 + i}", t, True)
    for i, (c, _, t, _) in enumerate([r for r in domain.DOCUMENT_MAP if r[3]] + [r for r in domain.DOCUMENT_MAP if r[3]][:2])
)

LANGUAGES = ("en", "fr", "de", "es")


def sensor_formula(position: int, value: str, k: str, user: str) -> str:
    """Reading of the n-th sensor; zero for some k, so that ratios meet zeros."""
    a, b, c = 0.0137113 * (position % 7 + 1), 0.1251719 * (position % 3 + 1), 0.5037 * (position % 2)
    m, p, z = position % 5 + 2, position % 4 + 3, position + 29
    return (
        f"CASE WHEN {k} % {z} = 7 THEN 0e0 ELSE {value} * {a:e} + ({k} % {m}) * {b:e} + ({user} % {p}) * {c:e} END"
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


K = "cast(get_json_object(props, '$.k') as int)"


def raw_readings(events: DataFrame, sensors: Sequence[str] = (), fault: Column | None = None, kept: Sequence[str] = ()) -> DataFrame:
    """Events as readings with a raw label and the sensor values asked for; other columns only as ``kept`` names them."""
    if fault is None:
        choices = F.array(*[F.lit(x).cast("string") for x in RAW_LABELS])
        fault = F.element_at(choices, F.col("k") % len(RAW_LABELS) + 1)
    base = events.select("event_id", "ts", "user_id", "value", F.expr(K).alias("k"), *kept)
    return base.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        *[F.expr(sensor_formula(domain.SENSORS.index(s), "value", "k", "user_id")).alias(s) for s in sensors],
        fault.alias("fault"),
        *kept,
    )


def readings(events: DataFrame, sensors: Sequence[str] = ()) -> DataFrame:
    return labels.with_category(raw_readings(events, sensors))


# A raw label that follows from the value of an event, with gaps between the bands in which a reading has none; readings whose sensors are all silent have none either.
GRADE = "CASE WHEN k = 7 THEN NULL WHEN value < 15e0 THEN 'Normal 1' WHEN value >= 30e0 AND value < 60e0 THEN ' polia_b' WHEN value >= 90e0 THEN 'VENTOINHA' END"


def graded(events: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """Events as readings with all features, whose label can be told from the sensors."""
    return add_features(labels.with_category(raw_readings(events, domain.SENSORS, F.expr(GRADE), kept)))


def graded_split(events: DataFrame) -> DataFrame:
    """The events that have a label, as they came, and whether each is for the test. Written once.

    A reading has ten times the bytes of its event, so it is worked out again where it is read.
    """
    source = ("event_id", "ts", "user_id", "value", "props")
    rows = graded(events.withColumn("_event", F.struct(*source)), ["_event"]).filter("fault is not null")
    marked = stratified_split(rows, "fault_category", "id", columns=[c for c in rows.columns if c != "_event"])
    return written(marked.select("_event.*", "is_test"), "graded_split", **PACKED)


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is costly per row."""
    return spread(table(spark, sf_dir, name))


def line_sensors(lineitem: DataFrame) -> DataFrame:
    """Order lines as readings, for the numeric operators."""
    value, k, user = "(l_extendedprice / 1e3)", "(l_linenumber + cast(l_quantity as int))", "l_suppkey"
    return lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        *[F.expr(sensor_formula(i, value, k, user)).alias(s) for i, s in enumerate(domain.SENSORS)],
    )


# Text numbers with the faults a CSV column can have.
TEXT_NUMBER = (
    "CASE k % 11 WHEN 0 THEN 'abc' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'NaN' WHEN 4 THEN 'inf' "
    "WHEN 5 THEN '1.5d' WHEN 6 THEN concat(' ', cast(value as {text}), ' ') WHEN 7 THEN '0x10' WHEN 8 THEN '-2.5e1' "
    "ELSE cast(value as {text}) END"
)

# CSV line of an event, with broken numbers and times, fields too many and fields too few.
CSV_LINE = (
    "concat(CASE WHEN k % 17 = 3 THEN 'x' ELSE '' END, cast(event_id as {text}), ',', CASE WHEN k % 13 = 5 THEN 'ontem' ELSE '2024-01-02 03:04:05' END, "
    "CASE WHEN k % 23 = 6 THEN '' ELSE concat(',', cast(k as {text}), ',polia') END, CASE WHEN k % 19 = 4 THEN ',1' ELSE '' END)"
)


def csv_lines(events: DataFrame) -> DataFrame:
    """One column whose name is the header and whose values are the lines."""
    based = events.select("event_id", F.expr(K).alias("k"))
    return based.select(F.expr(CSV_LINE.format(text="string")).alias("id,created_at,rpm,fault"))


# JSON payload of an event, with the defects the ingest has to handle.
_FIELDS = [
    ("rpm", "CASE WHEN k % 7 = 0 THEN concat('\"', cast(value as {text}), '\"') ELSE cast(value as {text}) END"),
    ("x_kurtosis", "CASE WHEN k % 13 = 0 THEN '\"abc\"' ELSE cast(k as {text}) END"),
] + [
    (name, f"cast(value + {i} as {{text}})")
    for i, name in enumerate(n for n in domain.REQUIRED_FIELDS if n not in ("rpm", "x_kurtosis", "z_kurtosis"))
]
PAYLOAD = (
    "CASE WHEN k % 23 = 0 THEN concat('{{\"id\": ', cast(event_id as {text}), ', \"rpm\": ') ELSE concat('{{\"id\": ', cast(event_id as {text}), "
    + ", ".join(f"', \"{n}\": ', {e}" for n, e in _FIELDS)
    + ", CASE WHEN k % 11 = 0 THEN '' ELSE concat(', \"z_kurtosis\": ', cast(k + 1 as {text})) END"
    + ", CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN ', \"temperature_f\": null' ELSE concat(', \"temperature_f\": ', cast(value as {text})) END"
    + ", ', \"extra\": true}}') END"
)


def payloads(events: DataFrame) -> DataFrame:
    """One JSON text per event, some of them broken, partial or quoted."""
    based = events.select("event_id", "ts", "value", F.expr(K).alias("k"))
    return based.select("event_id", F.expr(PAYLOAD.format(text="string")).alias("payload"))


def text_numbers(events: DataFrame) -> DataFrame:
    based = events.select("event_id", "value", F.expr(K).alias("k"))
    return based.select("event_id", F.expr(TEXT_NUMBER.format(text="string")).alias("raw"))


WIDTH = 64


def folded_places(place: int) -> list[int]:
    """Components that count for one class: every fourteenth."""
    return list(range(place, WIDTH, len(CLASSES)))


def probabilities(embedding: Column) -> Column:
    """Shares of the classes: component i adds its absolute size to class i modulo 14."""

    def size(place: int) -> Column:
        return F.coalesce(F.abs(F.get(embedding, F.lit(place)).cast("double")), F.lit(0.0))

    sums = []
    for place in range(len(CLASSES)):
        first, *others = [size(p) for p in folded_places(place)]
        for other in others:
            first = first + other
        sums.append(first)
    part = F.array(*sums)
    total = F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    return F.transform(part, lambda x: x / total)


def scored(embeddings: DataFrame) -> DataFrame:
    """Vectors as scored events: class shares, predicted category, confidence."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    return embeddings.select("vec_id", "label", probabilities(F.col("embedding")).alias("p")).select(
        "vec_id",
        "label",
        "p",
        arrays.predicted(names, F.col("p")).alias("fault_category"),
        arrays.confidence(F.col("p")).alias("confidence"),
    )


def history(embeddings: DataFrame, events: DataFrame) -> DataFrame:
    """Vectors as historical readings: features and the reading of the same number."""
    vectors = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    shown = ("rpm", "temperature_c", "z_rms_velocity_mm_s", "x_rms_velocity_mm_s")
    return readings(events, shown).join(vectors, "id")


def manual_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MANUAL_SOURCES), "fault_category string, doc_id string, title string, has_document boolean")


def named(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.concat(F.lit("Doc"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("doc_name"), "doc_id", "source", "lang", "text"
    )


def manuals(documents: DataFrame) -> DataFrame:
    """Documents as manuals with their chunks; paragraphs are single lines here."""
    return docs.with_chunks(named(documents), separator="\n")


def matched_manuals(documents: DataFrame, mapping: DataFrame) -> DataFrame:
    matched = docs.named_documents(named(documents), mapping, name="source")
    return docs.fan_out(docs.with_chunks(matched, separator="\n"))


def registry_winners(documents: DataFrame, mapping: DataFrame, newest: bool = True) -> DataFrame:
    """The manual of each category: the one with the highest document number, or with the lowest.

    Found by the numbers alone; no text is read.
    """
    matched = docs.fan_out(docs.named_documents(named(documents).drop("text"), mapping, name="source"))
    place = F.col("doc_id") if newest else -F.col("doc_id")
    return latest_per_key(matched.withColumn("_place", place), ["fault_category"], ["_place"]).drop("_place")


def registry(documents: DataFrame, mapping: DataFrame, newest: bool = True) -> DataFrame:
    """One manual per category; only the winners' texts are joined and chunked."""
    winners = small_side(registry_winners(documents, mapping, newest))
    texts = documents.select(F.col("doc_id").alias("_doc"), "text")
    full = texts.join(winners, F.col("_doc") == F.col("doc_id")).drop("_doc")
    return docs.registry_rows(docs.with_chunks(full, separator="\n"))


def document_chunks(documents: DataFrame) -> DataFrame:
    """All chunks of all documents with an id of document and position."""
    return manuals(documents).select(
        "doc_id", "lang", F.posexplode("chunks").alias("chunk_index", "text")
    ).withColumn("chunk_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))


def conversation_pages(conversations: DataFrame) -> DataFrame:
    """Turns as pages: user turns have digital text, the others only recognised text."""
    user = F.col("role") == "user"
    return conversations.select(
        F.concat(F.lit("Doc"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("doc_name"),
        F.col("turn").cast("int").alias("page_idx"),
        F.when(user, F.col("text")).alias("digital_text"),
        F.when(F.col("role") != "system", F.col("text")).alias("ocr_text"),
    )


def validated_payloads(events: DataFrame) -> DataFrame:
    return event_json.validate(payloads(events))
