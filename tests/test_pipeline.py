import random

import pytest

from vibralake import domain
from vibralake.operators import classifier, features
from vibralake.plans import pipeline
from vibralake.streaming import jobs

LABELS = ("normal_2", "polia", "ventoinha_1")


@pytest.fixture(scope="module")
def known(spark, tmp_path_factory):
    rng = random.Random(5)
    folder = tmp_path_factory.mktemp("work")
    lines = [",".join(["id", "created_at", *domain.SENSORS, "fault"])]
    for i in range(240):
        kind = i % 3
        values = [str(round(10 * kind + rng.random() + j * 0.1, 3)) for j in range(len(domain.SENSORS))]
        lines.append(",".join([str(i), f"2026-01-{i % 28 + 1:02d} 00:00:00+00:00", *values, LABELS[kind]]))
    (folder / "raw.csv").write_text("\n".join(lines))
    pages = spark.createDataFrame(
        [("Doc5.pdf", 0, "Trocar a polia gasta e alinhar o conjunto completo", None)],
        "doc_name string, page_idx int, digital_text string, ocr_text string",
    )
    return pipeline.build(spark, str(folder / "raw.csv"), pages, str(folder), classifier.Forest(trees=10, depth=5)), folder


def events(spark):
    rows = []
    for given, kind in ((7, 0), (7, 1), (None, 2)):
        rows.append((given, *[10.0 * kind + 0.5 + j * 0.1 for j in range(len(domain.SENSORS))]))
    frame = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in domain.SENSORS))
    return features.add_features(frame)


@pytest.mark.parametrize("few", [1000, 0])
def test_answers(spark, known, few):
    rows = pipeline.answer(events(spark), known[0], 5, few=few).collect()
    assert sorted((r["event_id"] or 0, r["fault_category"], r["route"]) for r in rows) == [
        (0, "ventoinha", "undocumented"), (7, "normal", "normal"), (7, "polia", "documented"),
    ]
    polia = next(r for r in rows if r["fault_category"] == "polia")
    assert polia["referenced_docs"] == ["Doc5.pdf"] and "Trocar a polia gasta" in polia["prescription"]
    assert "- ID do Evento: 7\n" in polia["prescription"]
    assert polia["similar_count"] == 5 and len(polia["top_matches"]) == 5
    assert {m["fault_category"] for m in polia["top_matches"]} == {"polia"}
    assert polia["total_historical_occurrences"] == 80 and sum(polia["time_distribution"].values()) == 80
    lost = next(r for r in rows if r["fault_category"] == "ventoinha")
    assert "ID do Evento" not in lost["prescription"] and lost["event_id"] is None


def test_stored_results(spark, known):
    folder = known[1]
    assert spark.read.parquet(str(folder / "sensor_readings")).count() == 240
    assert spark.read.json(str(folder / "evaluation")).first()["total_samples"] == 240
    assert spark.read.parquet(str(folder / "texts")).first()["stem"] == "Doc5"


def test_stream_of_events(spark, known, tmp_path):
    source = str(tmp_path / "events")
    events(spark).write.parquet(source)
    stream = spark.readStream.schema(events(spark).schema).parquet(source)
    out = str(tmp_path / "log")
    jobs.write_prescriptions(stream, lambda b: pipeline.answer(b, known[0], 5), out, str(tmp_path / "state")).awaitTermination()
    log = spark.read.parquet(out)
    assert log.count() == 3 and log.filter("has_document").count() == 1
    assert {r["similar_count"] for r in log.collect()} == {5}
