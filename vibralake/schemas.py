"""Schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

from vibralake import domain

RAW_READINGS = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("created_at", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in domain.SENSORS]
    + [T.StructField("fault", T.StringType())]
)

PAGES = "doc_name string, page_idx int, digital_text string, ocr_text string"
DOCUMENT_MAP = "fault_category string, doc_id string, title string, has_document boolean"
FAULT_DOCUMENTS = (
    "fault_category string, document_name string, document_path string, title string, "
    "text_content string, chunk_count int, uploaded_at timestamp"
)
CHUNKS = (
    "chunk_id string, text string, source_doc string, fault_category string, "
    "title string, chunk_index int"
)
PRESCRIPTIONS = (
    "event_id long, fault_category string, confidence double, similar_count int, "
    "prescription_text string, has_document boolean, raw_event_json string, created_at timestamp"
)
CHAT_LOG = (
    "session_id string, role string, message string, event_context string, `timestamp` timestamp"
)
