"""Page text -> document text -> chunks -> category index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vibralake import domain
from vibralake.functions import text as tx
from vibralake.operators import upsert as up
from vibralake.session import computed_once, small_side


def route_pages(pages: DataFrame) -> DataFrame:
    """Choose each page's text: digital when long enough, else recognised text.

    Pages with neither are dropped. Adds ``text`` and ``is_ocr``.
    """
    digital = tx.strip(F.coalesce("digital_text", F.lit("")))
    use_digital = F.length(digital) > domain.MIN_DIGITAL_CHARS
    ocr = F.col("ocr_text")
    return (
        pages.withColumn("is_ocr", ~use_digital)
        .withColumn("text", F.when(use_digital, digital).otherwise(F.when(F.length(ocr) > 0, ocr)))
        .filter("text is not null")
    )


def assemble(routed: DataFrame, key: str = "doc_name", page: str = "page_idx") -> DataFrame:
    """One text per document: every page under its header, in page order.

    The text of a document is one value by definition, so its pages meet in
    one row; documents are spread over the cluster by name.
    """
    marked = F.concat(tx.page_header(F.col(page) + 1, F.col("is_ocr")), F.col("text"))
    pages = F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), marked.alias("text"))))
    return routed.groupBy(key).agg(F.array_join(F.transform(pages, lambda p: p["text"]), "\n").alias("text"))


def chunk_array(
    text: str = "text", size: int = domain.CHUNK_SIZE, overlap: int = domain.CHUNK_OVERLAP, separator: str = "\n\n"
) -> Column:
    """Chunks of a text column, see ``with_chunks`` for whole tables."""
    parts = tx.paragraphs(F.col(text), separator)
    return _join_spans(parts, F.col(text), size, overlap, separator)


def _join_spans(parts: Column, text: Column, size: int, overlap: int, separator: str) -> Column:
    spans = tx.chunk_spans(F.transform(parts, F.length), size)
    joined = F.transform(spans, lambda s: F.array_join(F.slice(parts, s["first"] + 1, s["count"]), separator))
    return (
        F.when(F.length(text) == 0, F.array().cast("array<string>"))
        .when(F.size(parts) == 0, tx.window_chunks(text, size, overlap))
        .otherwise(joined)
    )


def with_chunks(
    documents: DataFrame,
    text: str = "text",
    size: int = domain.CHUNK_SIZE,
    overlap: int = domain.CHUNK_OVERLAP,
    separator: str = "\n\n",
) -> DataFrame:
    """Add ``chunks``: overlapping groups of paragraphs of about ``size`` characters.

    A paragraph is never cut, and the last one of a chunk opens the next. Text
    of white space only is cut into windows instead. Paragraphs are a column of
    their own, so they are split once per document.
    """
    held = computed_once(documents, _parts=tx.paragraphs(F.col(text), separator))
    joined = _join_spans(F.col("_parts"), F.col(text), size, overlap, separator)
    return computed_once(held, chunks=joined).drop("_parts")


def categories_by_document(document_map: DataFrame) -> DataFrame:
    """``(_manual, _named)``: per manual the categories and titles that name it."""
    entries = F.array_sort(F.collect_list(F.struct("fault_category", "title")))
    return document_map.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_manual")).agg(entries.alias("_named"))


def named_documents(documents: DataFrame, document_map: DataFrame, name: str = "doc_name") -> DataFrame:
    """Documents that some category names, with these categories as an array.

    One row per document, so that the text is chunked once and not once per
    category; ``fan_out`` unfolds the categories afterwards.
    """
    named = small_side(categories_by_document(document_map))
    return documents.join(named, F.col(name) == F.col("_manual")).drop("_manual")


def fan_out(named: DataFrame) -> DataFrame:
    """One row per document and category that names it."""
    return named.select(*[c for c in named.columns if c != "_named"], F.inline("_named"))


def chunk_id(name: Column, category: Column, index: Column) -> Column:
    return F.concat(name, F.lit("_"), category, F.lit("_chunk_"), index.cast("string"))


def index_rows(matched: DataFrame, name: str = "doc_name") -> DataFrame:
    """Chunk rows with id and metadata, one per document, category and chunk."""
    exploded = matched.select(F.col(name).alias("source_doc"), "fault_category", "title", F.posexplode("chunks").alias("chunk_index", "text"))
    return exploded.select(
        chunk_id(F.col("source_doc"), F.col("fault_category"), F.col("chunk_index")).alias("chunk_id"),
        "text",
        "source_doc",
        "fault_category",
        "title",
        "chunk_index",
    )


def registry_rows(matched: DataFrame, name: str = "doc_name", path: Column | None = None) -> DataFrame:
    """Registry rows of the matched documents, before the upsert by category."""
    return matched.select(
        "fault_category",
        F.col(name).alias("document_name"),
        (F.col(name) if path is None else path).alias("document_path"),
        "title",
        F.col("text").alias("text_content"),
        F.size("chunks").alias("chunk_count"),
        F.current_timestamp().alias("uploaded_at"),
    )


def document_summary(documents: DataFrame, document_map: DataFrame, name: str = "doc_name", key: str | None = None) -> DataFrame:
    """Categories, chunk count and text length per document, unmatched ones too.

    Categories are gathered on the small map first, so documents are not
    multiplied and not grouped. ``key`` is the column that the map refers to.
    """
    named = small_side(categories_by_document(document_map))
    joined = documents.join(named, F.col(key or name) == F.col("_manual"), "left")
    return joined.select(
        name,
        F.coalesce(F.transform("_named", lambda n: n["fault_category"]), F.array().cast("array<string>")).alias("categories"),
        F.size("chunks").alias("chunks"),
        F.length("text").alias("text_length"),
    )


def upsert_registry(current: DataFrame, incoming: DataFrame, order: tuple[str, ...] = ("document_name",)) -> DataFrame:
    """Registry with one row per category, the incoming one where both have it."""
    return up.upsert(current, incoming, ["fault_category"], order)


def upsert_chunks(current: DataFrame, incoming: DataFrame, replace_document: bool = False) -> DataFrame:
    """Chunk collection with incoming chunks put in by id.

    Chunks of a shortened document that have no new counterpart stay, unless
    ``replace_document`` removes all old chunks of the incoming documents first.
    """
    if replace_document:
        renewed = incoming.select("source_doc", "fault_category").distinct()
        current = current.join(renewed, ["source_doc", "fault_category"], "left_anti")
    order = [c for c in ("text", "source_doc", "fault_category") if c in incoming.columns]
    return up.upsert(current, incoming, ["chunk_id"], order)


def ingest_documents(pages: DataFrame, **chunking) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Uploaded manuals to registry rows, chunk rows and counts.

    ``pages`` carries ``doc_name, fault_category, title`` beside the page text. A
    document without any text is registered with no chunks; one file uploaded for
    two categories is a manual of both.
    """
    names = pages.select("doc_name", "fault_category", "title").distinct()
    texts = names.join(assemble(route_pages(pages)), "doc_name", "left").withColumn("text", F.coalesce("text", F.lit("")))
    texts = with_chunks(texts, **chunking)
    counts = texts.select(
        F.lit("success").alias("status"),
        F.col("doc_name").alias("filename"),
        "fault_category",
        F.size("chunks").alias("chunks_indexed"),
    )
    return registry_rows(texts), index_rows(texts), counts


def discover(pages: DataFrame, pattern: str = r"^Doc.*\.pdf$") -> DataFrame:
    """Pages of the documents whose name fits the pattern, by name."""
    return pages.filter(F.col("doc_name").rlike(pattern)).orderBy("doc_name", "page_idx")
