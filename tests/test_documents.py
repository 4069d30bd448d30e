import random

import pytest
from pyspark.sql import functions as F

from vibralake import domain
from vibralake.operators import documents, prescribe


def plain_chunks(text, size=500, overlap=50, separator="\n\n"):
    """Independent statement of the chunking rule."""
    parts = [p.strip() for p in text.split(separator) if p.strip()]
    chunks, held = [], []
    for part in parts:
        if held and sum(map(len, held)) + len(part) > size:
            chunks.append(separator.join(held))
            held = held[-1:] if len(held) > 1 else []
        held.append(part)
    if held:
        chunks.append(separator.join(held))
    if not chunks:
        chunks = [text[i : i + size] for i in range(0, len(text), size - overlap)]
    return chunks


def chunked(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["chunks"] for r in documents.with_chunks(rows, **options).orderBy("i").collect()]


def test_known_chunks(spark):
    text = "\n\n".join(["aaaa", "bbbb", "cccc", "dddddddddddd", "e"])
    assert chunked(spark, [text], size=10) == [
        ["aaaa\n\nbbbb", "bbbb\n\ncccc", "cccc\n\ndddddddddddd", "dddddddddddd\n\ne"]
    ]


def test_random_texts(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(200):
        parts = ["é" * rng.choice([1, 3, 10, 49, 50, 120]) for _ in range(rng.randrange(0, 30))]
        texts.append("".join(p + rng.choice(["\n\n", "\n\n\n", "\n", " \n\n\t"]) for p in parts))
    texts += ["", " " * 120, "\n" * 37, "x" * 2000]
    assert chunked(spark, texts, size=50, overlap=5) == [plain_chunks(t, 50, 5) for t in texts]


def test_separator_is_literal(spark):
    assert chunked(spark, ["a.b.c"], size=1, separator=".") == [plain_chunks("a.b.c", 1, separator=".")]


PAGES = [
    ("Doc2.pdf", 1, "b" * 30, None, ),
    ("Doc2.pdf", 0, "  " + "a" * 31 + "\n", "ignored"),
    ("Doc2.pdf", 2, "short", "recognised"),
    ("Doc2.pdf", 3, None, ""),
    ("Other.pdf", 0, "o" * 40, None),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "doc_name string, page_idx int, digital_text string, ocr_text string")


def test_routing_and_assembly(spark):
    texts = {r["doc_name"]: r["text"] for r in documents.assemble(documents.route_pages(pages(spark))).collect()}
    assert texts["Doc2.pdf"] == f"\n--- Página 1 ---\n{'a' * 31}\n\n--- Página 3 (OCR) ---\nrecognised"


def test_discovery(spark):
    assert [r["doc_name"] for r in documents.discover(pages(spark)).select("doc_name").distinct().collect()] == ["Doc2.pdf"]


@pytest.fixture(scope="module")
def manuals(spark):
    rows = spark.createDataFrame(
        [("Doc1.pdf", "alpha\n\nbeta"), ("Doc2.pdf", "gamma"), ("Doc9.pdf", "nobody")], "doc_name string, text string"
    )
    return rows


def test_fan_out_and_ids(spark, manuals):
    mapping = prescribe.document_map(spark)
    named = documents.with_chunks(documents.named_documents(manuals, mapping), size=5)
    rows = documents.index_rows(documents.fan_out(named)).collect()
    assert len(rows) == 4 * 2 + 1
    ids = {r["chunk_id"] for r in rows}
    assert "Doc1.pdf_rolamento_combinado_chunk_1" in ids and "Doc2.pdf_desalinhamento_chunk_0" in ids
    title = next(r["title"] for r in rows if r["source_doc"] == "Doc2.pdf")
    assert title == "Procedimento para Correção de Desalinhamento em Motor Elétrico"


def test_summary_reports_unmatched(spark, manuals):
    found = {r["doc_name"]: r for r in documents.document_summary(documents.with_chunks(manuals), prescribe.document_map(spark)).collect()}
    assert found["Doc9.pdf"]["categories"] == [] and found["Doc9.pdf"]["chunks"] == 1
    assert len(found["Doc1.pdf"]["categories"]) == 4 and found["Doc1.pdf"]["text_length"] == 11


def registry(spark, rows):
    return spark.createDataFrame(rows, "fault_category string, document_name string, chunk_count int")


def test_registry_upsert(spark):
    old = registry(spark, [("polia", "Doc5.pdf", 3), ("correia", "Doc4.pdf", 2)])
    new = registry(spark, [("polia", "New.pdf", 1), ("ventoinha", "V.pdf", 9)])
    found = {r["fault_category"]: r["document_name"] for r in documents.upsert_registry(old, new).collect()}
    assert found == {"polia": "New.pdf", "correia": "Doc4.pdf", "ventoinha": "V.pdf"}


def chunk_rows(spark, names):
    rows = [(f"d_c_chunk_{i}", t, "d", "c", "t", i) for i, t in names]
    return spark.createDataFrame(rows, "chunk_id string, text string, source_doc string, fault_category string, title string, chunk_index int")


def test_chunk_upsert_keeps_stale_tail(spark):
    old, new = chunk_rows(spark, [(0, "a"), (1, "b")]), chunk_rows(spark, [(0, "A")])
    kept = {r["chunk_id"]: r["text"] for r in documents.upsert_chunks(old, new).collect()}
    assert kept == {"d_c_chunk_0": "A", "d_c_chunk_1": "b"}
    replaced = documents.upsert_chunks(old, new, replace_document=True).collect()
    assert [r["text"] for r in replaced] == ["A"]


def test_ingest(spark):
    uploads = pages(spark).filter("doc_name = 'Doc2.pdf'").withColumns(
        {"fault_category": F.lit("ventoinha"), "title": F.lit("Manual")}
    )
    rows, chunks, counts = documents.ingest_documents(uploads)
    assert counts.first().asDict() == {
        "status": "success", "filename": "Doc2.pdf", "fault_category": "ventoinha", "chunks_indexed": 1,
    }
    assert rows.first()["title"] == "Manual" and chunks.first()["chunk_id"] == "Doc2.pdf_ventoinha_chunk_0"


def test_chunks_are_computed_once(spark, manuals):
    plan = documents.with_chunks(manuals).select(F.posexplode("chunks"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("aggregate(") == 1
