import datetime as dt
import json

from pyspark.sql import functions as F

from vibralake import domain, schemas
from vibralake.operators import dashboard, prescribe
from vibralake.streaming import jobs

FULL = {c: 1.0 for c in domain.REQUIRED_FIELDS}


def write_lines(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines))


def test_validated_stream(spark, tmp_path):
    source = tmp_path / "in"
    write_lines(source, "1.txt", [json.dumps({**FULL, "id": 1}), "{bad"])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        jobs.write_validated(jobs.payload_stream(spark, str(source)), out, state).awaitTermination()
        return {r["status"]: r["n"] for r in spark.read.parquet(out).groupBy("status").agg(F.count("*").alias("n")).collect()}

    assert run() == {"accepted": 1, "refused": 1}
    assert run() == {"accepted": 1, "refused": 1}
    write_lines(source, "2.txt", [json.dumps({**FULL, "id": 2})])
    assert run() == {"accepted": 2, "refused": 1}


def test_typed_stream(spark, tmp_path):
    source = tmp_path / "in"
    write_lines(source, "1.txt", [json.dumps({**FULL, "id": 1, "created_at": "2024-01-01 00:00:00+00:00"}), "{bad"])
    events = jobs.typed_events(jobs.validated(jobs.payload_stream(spark, str(source))))
    query = events.writeStream.format("memory").queryName("typed").trigger(availableNow=True).start()
    query.awaitTermination()
    row = spark.table("typed").first()
    assert row["id"] == 1 and row["total_vibration_energy"] == 4.0 and row["temperature_f"] == 76.44


def test_daily_counts_equal_batch(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(hours=7 * i), "polia" if i % 2 else "normal", bool(i % 2)) for i in range(40)]
    path = str(tmp_path / "readings")
    frame = spark.createDataFrame(rows, "id long, created_at timestamp, fault_category string, is_problem boolean")
    frame.write.parquet(path)
    stream = spark.readStream.schema(frame.schema).parquet(path)
    query = (
        jobs.daily_fault_counts(stream).writeStream.outputMode("complete").format("memory").queryName("daily")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    want = {tuple(r) for r in dashboard.daily_timeline(frame).collect()}
    assert {tuple(r) for r in spark.table("daily").collect()} == want


def test_prescription_log(spark, tmp_path):
    path = str(tmp_path / "events")
    now = dt.datetime(2024, 1, 1)
    rows = [(1, now, "normal", 99.0), (1, now, "normal", 99.0), (2, now, "ventoinha", 80.0)]
    frame = spark.createDataFrame(rows, "id long, created_at timestamp, fault_category string, confidence double")
    frame.write.parquet(path)
    registry = spark.createDataFrame([], schemas.FAULT_DOCUMENTS)
    texts = spark.createDataFrame([], "fault_category string, excerpts array<string>")
    mapping = prescribe.document_map(spark)

    def answer(batch):
        return prescribe.prescribe(batch, registry, mapping, texts)

    def run(name, window):
        stream = spark.readStream.schema(frame.schema).parquet(path)
        out = str(tmp_path / name)
        jobs.write_prescriptions(stream, answer, out, str(tmp_path / f"{name}-state"), window).awaitTermination()
        return sorted(r["event_id"] for r in spark.read.parquet(out).collect())

    assert run("log", None) == [1, 1, 2]
    assert run("once", "1 day") == [1, 2]


def test_ids_seen_by_a_stream_lie_in_files(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("events", "log", "state"))
    rows = [(i % 50, dt.datetime(2024, 1, 1), "normal", 99.0) for i in range(100)]
    frame = spark.createDataFrame(rows, "id long, created_at timestamp, fault_category string, confidence double")
    registry = spark.createDataFrame([], schemas.FAULT_DOCUMENTS)
    texts = spark.createDataFrame([], "fault_category string, excerpts array<string>")
    mapping = prescribe.document_map(spark)
    for _ in range(2):
        frame.write.mode("append").parquet(path)
        stream = spark.readStream.schema(frame.schema).parquet(path)
        jobs.write_prescriptions(stream, lambda b: prescribe.prescribe(b, registry, mapping, texts), out, state, "1 day").awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == list(range(50))
    kept = {f.suffix for f in (tmp_path / "state" / "state").rglob("*") if f.is_file() and not f.name.startswith((".", "_"))}
    # snapshots of a store with a bounded cache, not deltas of a map of all keys on the heap
    assert ".zip" in kept and ".delta" not in kept
