"""Cases that lie outside the given tables: odd files, ties, nulls, broken JSON."""

import json

import pytest
from pyspark.sql import functions as F

from vibralake import domain, session
from vibralake.operators import documents, evaluation, event_json, similarity, split, topk
from vibralake.plans import tables
from vibralake.sources import readings
from vibralake.streaming import jobs


def test_csv_files_with_their_own_column_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,rpm,temperature_c,fault\n1,1000,25,polia\n")
    (tmp_path / "b.csv").write_text("temperature_c,id,fault,rpm\n30,2,correia,900\n")
    found = readings.scan_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted((r.id, r.rpm, r.temperature_c) for r in found.collect()) == [(1, "1000", "25"), (2, "900", "30")]
    with pytest.raises(Exception, match="CSV header"):
        readings.scan_csv(spark, str(tmp_path)).collect()


def test_split_of_repeated_and_missing_ids(spark):
    rows = [(1, "a", i) for i in range(100)] + [(None, "b", i) for i in range(50)] + [(i, "c", 0) for i in range(50)] + [(7, "d", 0)] * 40
    df = spark.createDataFrame(rows, "id long, label string, x int")
    found = split.stratified_split(df, "label", "id").groupBy("label").agg(F.sum(F.col("is_test").cast("int")).alias("n"), F.count("*").alias("of"))
    assert {r.label: (r.n, r.of) for r in found.collect()} == {"a": (20, 100), "b": (10, 50), "c": (10, 50), "d": (8, 40)}


def test_confusion_keeps_missing_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None), (None, "b"), (None, None), ("b", "a")], "label string, prediction string")
    cells = evaluation.confusion_matrix(evaluation.pair_counts(df)).collect()
    assert sum(r.n for r in cells) == 5 and len(cells) == 9


def parsed(spark, text):
    return event_json.validate(spark.createDataFrame([(text,)], "payload string"))


FULL = {c: 1.0 for c in domain.REQUIRED_FIELDS}


@pytest.mark.parametrize(
    "text,valid",
    [
        (json.dumps({**FULL, "id": 5.0}), True),
        (json.dumps({**FULL, "rpm": True}), True),
        (json.dumps({**FULL, "rpm": "true"}), False),
        (json.dumps({**FULL, "id": 5.5}), False),
        (json.dumps(FULL) + " tail", False),
        (json.dumps(FULL) + json.dumps(FULL), False),
        (json.dumps(FULL) + "," + json.dumps(FULL), False),
        (json.dumps([FULL]), False),
        (None, False),
    ],
)
def test_event_json_edges(spark, text, valid):
    assert parsed(spark, text).first()["is_valid"] is valid


def test_last_of_repeated_keys_and_whole_numbers(spark):
    text = json.dumps({**FULL, "id": 5.0})[:-1] + ', "rpm": 2.0, "x_kurtosis": true}'
    row = event_json.sensor_columns(parsed(spark, text)).first()
    assert (row["id"], row["rpm"], row["x_kurtosis"]) == (5, 2.0, 1.0)


def test_vectors_with_nulls_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.9, 0.1]), (4, [None, 1.0]), (5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id smallint, features array<double>")
    for few in (100, 0):
        found = similarity.nearest(df, df, k=2, strict=False, few=few).collect()
        assert {r.query_id for r in found} == {1, 3, 5} and len(found) == 6


def test_search_in_the_group_of_the_query(spark):
    rows = [(i, [float(i % 7), 1.0], "a" if i % 3 else "b") for i in range(60)] + [(99, None, "a"), (98, [1.0, 1.0], None)]
    items = spark.createDataFrame(rows, "item_id string, vector array<float>, label string")
    asked = items.withColumnRenamed("item_id", "query_id")
    found = similarity.by_vector(asked, items, 3, "label").collect()
    groups = {str(i): g for i, _, g in rows}
    assert len(found) == 180 and all(groups[r.query_id] == groups[r.item_id] for r in found)


def test_uploads_without_text_are_registered(spark):
    pages = spark.createDataFrame(
        [("Doc1.pdf", 0, "x" * 60, None, "polia", "T"), ("Doc2.pdf", 0, None, None, "correia", "U"), ("Doc1.pdf", 0, "x" * 60, None, "correia", "T")],
        "doc_name string, page_idx int, digital_text string, ocr_text string, fault_category string, title string",
    )
    registry, chunks, counts = documents.ingest_documents(pages)
    assert registry.count() == 3
    assert {(r.filename, r.fault_category): r.chunks_indexed > 0 for r in counts.collect()} == {
        ("Doc1.pdf", "polia"): True, ("Doc1.pdf", "correia"): True, ("Doc2.pdf", "correia"): False,
    }


def test_every_component_counts(spark):
    vector = [0.0] * 64
    vector[60] = -2.0  # the class of place 60 modulo 14
    row = spark.createDataFrame([(1, 0, vector)], "vec_id long, label int, embedding array<float>")
    found = tables.scored(row).first()
    assert found["fault_category"] == tables.CLASSES[60 % 14] and found["confidence"] == 100.0


def test_no_shared_folder_on_a_cluster_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(session, "is_local", lambda s: False)
    monkeypatch.setattr(session, "shared_dir", lambda s: None)
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda c: None)
    for helper in (session.durable, session.written):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            helper(spark.range(1))


def test_daily_counts_are_kept_up_to_date_and_late_rows_dropped(spark, tmp_path):
    schema = "created_at timestamp, fault_category string, is_problem boolean"

    def put(name, days):
        lines = [json.dumps({"created_at": f"2024-01-{d:02d}T08:00:00.000Z", "fault_category": "polia", "is_problem": True}) for d in days]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(lines))

    def run():
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        jobs.write_daily_counts(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return {str(r.date): r.occurrences for r in jobs.read_daily_counts(spark, str(tmp_path / "out")).collect()}

    put("1.json", [1, 1, 10])
    assert run() == {"2024-01-01": 2, "2024-01-10": 1}
    put("2.json", [10, 20])
    assert run() == {"2024-01-01": 2, "2024-01-10": 2, "2024-01-20": 1}
    put("3.json", [1, 20])  # the first is later than the watermark allows
    assert run() == {"2024-01-01": 2, "2024-01-10": 2, "2024-01-20": 2}


def test_key_types(spark):
    df = spark.createDataFrame([(1, [1.0])], "id tinyint, v array<double>")
    ddl, schema = topk._result_types(df, df, "id", "id")
    assert "tinyint" in ddl and str(schema.field("query_id").type) == "int8"
