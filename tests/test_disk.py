"""What lies on disk while a job runs, and what it leaves."""

from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vibralake import domain, session
from vibralake.operators import features, forest, search, similarity, split
from vibralake.plans import pipeline
from vibralake.plans import tables as t
from vibralake.streaming import jobs


def held(spark) -> dict[Path, int]:
    base = Path(session.shared_base(spark).removeprefix("file:"))
    return {f: f.stat().st_size for f in base.rglob("*") if f.is_file()}


@pytest.fixture
def left(spark):
    """Bytes and names of files in the shared folder that were not there when the test began."""
    before = held(spark)
    return lambda: {f: n for f, n in held(spark).items() if f not in before}


def events(spark, n=2_000):
    value = "round((id * 7919 % 1301) / 11e0, 2) AS value"
    return spark.range(n).selectExpr(
        "id % 1900 AS event_id", "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, id % 1900 % 20) AS ts", "id % 1900 % 17 AS user_id",
        value.replace("id", "(id % 1900)"), "concat('{\"k\": ', id % 1900 % 89, '}') AS props",
    )


def test_only_what_is_read_later_stays(spark, left):
    rows = spark.range(20).withColumn("x", F.rand(1))
    kept, gone = session.written(rows, "kept"), session.written(rows, "gone")
    session.discard(gone)
    assert kept.count() == 20 and {f.parent.name.partition("-")[0] for f in left()} == {"kept"}
    with pytest.raises(KeyError):
        session.discard(rows)  # no files of its own


def test_shuffle_files_end_with_their_job(spark):
    session.tune(spark)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"


def test_neighbours_leave_the_neighbours_only(spark, left):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    points = np.round(centres[rng.integers(12, size=3_000)] + 0.05 * rng.normal(size=(3_000, 16)), 2)
    points[:4] = 0.0
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, features array<double>").repartition(3)
    asked = frame.filter("id < 300")
    found = similarity.nearest(asked, frame, 3, few=0)
    assert sum(left().values()) < 0.1 * points.nbytes
    same = similarity.nearest(asked, frame, 3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, same.collect()))


def test_near_pivots_follow_each_other():
    rng = np.random.default_rng(4)
    line = rng.permutation(64)
    rows = np.stack([line, 0.1 * rng.normal(size=64)], axis=1)
    order = similarity._side_by_side(rows)
    assert sorted(order.tolist()) == list(range(64)) and np.abs(np.diff(line[order])).mean() < 8
    assert len(similarity._side_by_side(np.zeros((0, 3)))) == 0


def test_an_index_in_parts_is_the_same(spark, left, monkeypatch):
    monkeypatch.setattr(search, "SHARD_BYTES", 2_000)
    rows = spark.range(300).selectExpr("cast(id as string) AS chunk_id", "concat_ws(' ', 'motor', repeat('eixo ', cast(id % 7 AS int)), 'polia', char(97 + id % 5)) AS text").repartition(2)
    one = search.build_index(rows)
    assert not any("raw_shards" in str(f) for f in left())
    monkeypatch.setattr(search, "MEETING_BYTES", 1_000)
    parts = search.build_index(rows)
    columns = ["keys", "vocabulary", "idf", "order", "tf"]
    assert sorted(map(str, one.shards.select(columns).collect())) == sorted(map(str, parts.shards.select(columns).collect()))
    assert parts.size == 300 and parts.items.count() == 300


def test_a_forest_in_rounds_is_the_same(spark, left, monkeypatch):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(*map(float, r), f"c{int(r[0] > 0)}") for r in rng.normal(size=(400, 3))], "a double, b double, c double, label string")
    fit = lambda: forest.fit(rows, ["a", "b", "c"], "label", 6, 8, 2, 5, 3).nodes.to_pylist()
    whole = fit()
    assert not left()
    monkeypatch.setattr(forest, "DEALT_ROWS", 1)
    monkeypatch.setattr(forest, "DEALT_TREES", 1)
    assert fit() == whole
    assert list(forest.rounds({0: {2: 5, 3: 5}, 1: {1: 20}}, 10)) == [{0: [2, 3]}, {1: [1]}]


def test_split_events_are_the_split_readings(spark, left):
    given = events(spark)
    readings = t.graded(given).filter("fault is not null")
    want = split.stratified_split(readings, "fault_category", "id")
    marked = t.graded_split(given)
    assert sum(left().values()) < 150 * marked.count()  # readings take over 280 bytes each
    got = t.graded(marked.filter("is_test")).withColumn("is_test", F.lit(True)).unionByName(t.graded(marked.filter("not is_test")).withColumn("is_test", F.lit(False)))
    assert want.columns == got.columns and want.count() == got.count()
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_a_stored_history_has_no_derived_columns(spark, tmp_path):
    rows = t.graded(events(spark, 50))
    pipeline.store_history(rows, str(tmp_path / "new"))
    pipeline.history_rows(rows).write.parquet(str(tmp_path / "old"))
    new, old = (pipeline.stored_history(spark, str(tmp_path / name)) for name in ("new", "old"))
    assert new.columns == old.columns and new.exceptAll(old).isEmpty() and old.exceptAll(new).isEmpty()
    assert set(domain.SENSORS) < set(spark.read.parquet(str(tmp_path / "new")).columns) and "features" not in spark.read.parquet(str(tmp_path / "new")).columns


def test_answers_leave_events_and_neighbours_only(spark, left):
    from vibralake.operators import classifier, prescribe, scaling

    rows = t.graded(events(spark, 1_900)).filter("fault is not null")
    history = pipeline.history_rows(rows)
    model = classifier.train(rows, forest=classifier.Forest(trees=3, depth=4))
    registry = spark.createDataFrame([("polia", "Doc1.pdf", "Polia", 2)], "fault_category string, document_name string, title string, chunk_count int")
    texts = spark.createDataFrame([("polia", ["a", "b"])], "fault_category string, excerpts array<string>")
    known = pipeline.Knowledge(model, history, scaling.fit_array(history, "features"), registry, prescribe.document_map(spark), texts)
    before = sum(left().values())
    asked = rows.limit(600).withColumn("none", F.lit(None))
    answers = pipeline.answer(asked, known, 5, few=0).toPandas()
    assert len(answers) == 600 and (answers["top_matches"].map(len) == 5).all()
    assert '"none":null' in answers["raw_event_json"][0] and answers["event_id"].notna().all()
    # whole answers, stored twice over with their events as JSON text, took some 5,000 bytes each
    assert (sum(left().values()) - before) / 600 < 800


def test_the_prescription_log_is_packed(spark, tmp_path):
    rows = features.add_features(spark.createDataFrame([(1, *[1.0] * len(domain.SENSORS))], "id long, " + ", ".join(f"{c} double" for c in domain.SENSORS)))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    answer = lambda b: b.selectExpr("id AS event_id", "'polia' AS fault_category", "1e0 AS confidence", "'texto' AS prescription", "true AS has_document")
    jobs.write_prescriptions(stream, answer, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "log").rglob("*.parquet")]
    assert {f.row_group(0).column(0).compression for f in files if f.num_row_groups} == {"ZSTD"}
