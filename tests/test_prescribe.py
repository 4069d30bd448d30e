import pytest
from pyspark.sql import functions as F

from vibralake import domain, schemas
from vibralake.operators import chat, documents, prescribe, search

EVENTS = [
    (999, "desalinhamento", 95.0, 5, 1000, 1000.0, 25.0, 1000.0, 25.0),
    (998, "eccentric_rotor", 92.0, 5, 500, None, None, 1000.0, 25.0),
    (997, "normal", 99.0, 5, 5000, None, None, 1000.0, 23.0),
    (996, "outro_defeito", 51.26, 5, 1234567, None, None, 1000.0, 23.0),
]
SCHEMA = (
    "id long, fault_category string, confidence double, similar_count int, total_historical_occurrences long, "
    "avg_rpm double, avg_temp_c double, rpm double, temperature_c double"
)


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(EVENTS, SCHEMA)


@pytest.fixture(scope="module")
def chunks(spark):
    rows = spark.createDataFrame(
        [("Doc2.pdf", "\n--- Página 1 ---\nVerificar desalinhamento do eixo\n\n" + "x" * 600)], "doc_name string, text string"
    )
    named = documents.with_chunks(documents.named_documents(rows, prescribe.document_map(spark)))
    return documents.index_rows(documents.fan_out(named))


def run(spark, events, chunks, registry=None):
    registry = registry if registry is not None else spark.createDataFrame([], schemas.FAULT_DOCUMENTS)
    texts = prescribe.excerpts(events, chunks, search.build_index(chunks, group="fault_category"))
    rows = prescribe.prescribe(events, registry, prescribe.document_map(spark), texts, prompts=True).collect()
    return {r["event_id"]: r for r in rows}


def test_routes(spark, events, chunks):
    found = run(spark, events, chunks)
    documented = found[999]
    assert documented["has_document"] and documented["referenced_docs"] == ["Doc2.pdf"] and documented["chunks_used"] == 2
    text = documented["prescription"]
    assert text.startswith("### 🛠️ Prescrição Técnica: Desalinhamento\n\n**Diagnóstico de IA:** desalinhamento (Confiança: **95.0%**)\n")
    assert "*Página 1 ---" in text and "--- Página" not in text
    assert "- Total histórico nesta categoria: 1,000\n" in text and "- Rotação: 1000.0 RPM" in text
    assert text.endswith(domain.SYNTHESIS_TAIL[-1])
    assert "[Trecho 1]: " in documented["prompt"]

    missing = found[998]
    assert not missing["has_document"] and missing["referenced_docs"] == []
    assert "Ainda **não existe documentação técnica ou manual cadastrado**" in missing["prescription"]
    assert "registrar e anexar um novo documento" in missing["prescription"]
    assert "Eccentric Rotor" in missing["prescription"] and "**92.0%**" in missing["prescription"]

    normal = found[997]
    assert normal["is_operational_normal"] and "Estado Operacional: Normal" in normal["prescription"]
    assert normal["prescription"] == domain.NORMAL_TEXT and normal["prompt"] is None

    other = found[996]
    assert "**1,234,567**" in other["prescription"] and "**51.3%**" in other["prescription"]


def test_registry_wins_over_map(spark, events, chunks):
    row = ("eccentric_rotor", "New.pdf", "/x/New.pdf", "Novo", "text", 0, None)
    found = run(spark, events, chunks, spark.createDataFrame([row], schemas.FAULT_DOCUMENTS))
    assert found[998]["has_document"] and found[998]["referenced_docs"] == ["New.pdf"]
    assert found[998]["chunks_used"] == 0 and "*Novo*" in found[998]["prescription"]


def test_availability_defaults(spark, events):
    registry = spark.createDataFrame([], schemas.FAULT_DOCUMENTS)
    rows = prescribe.availability(events, registry, prescribe.document_map(spark)).collect()
    other = next(r for r in rows if r["fault_category"] == "outro_defeito")
    assert (other["has_document"], other["document_name"], other["title"], other["chunk_count"]) == (False, None, "Sem Documentação", 0)


def messages(spark):
    rows = [("one", 0, "user", "only")]
    rows += [("six", i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(6)]
    rows += [("eight", i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(8)]
    return spark.createDataFrame(rows, "session_id string, turn int, role string, message string")


def test_chat_window(spark):
    found: dict = {}
    for r in chat.recent_messages(messages(spark)).orderBy("turn").collect():
        found.setdefault(r["session_id"], []).append((r["turn"], r["role"]))
    assert "one" not in found
    assert [t for t, _ in found["six"]] == [0, 1, 2, 3, 4]
    assert found["eight"] == [(2, "user"), (3, "model"), (4, "user"), (5, "model"), (6, "user")]


def test_chat_prompt(spark):
    asked = spark.createDataFrame(
        [("six", "hello", True, "polia", 95.5), ("one", "hi", False, None, None)],
        "session_id string, message string, has_context boolean, fault_category string, confidence double",
    )
    found = {r["session_id"]: r for r in chat.prompts(asked, chat.recent_messages(messages(spark))).collect()}
    assert found["six"]["prompt"] == "[Contexto do Evento Atual: Defeito=polia, Confiança=95.5%]\nhello"
    assert [h["content"] for h in found["six"]["history"]] == ["m0", "m1", "m2", "m3", "m4"]
    assert found["one"]["prompt"] == "hi" and found["one"]["history"] == []


def test_log_rows(spark, events, chunks):
    turns = spark.createDataFrame([("s", "q", "a", '{"x": 1}')], "session_id string, message string, response string, event_context string")
    assert [(r["role"], r["message"]) for r in chat.log_rows(turns).collect()] == [("user", "q"), ("assistant", "a")]
