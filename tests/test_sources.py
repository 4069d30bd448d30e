import datetime as dt

import pytest

from vibralake import domain
from vibralake.operators import upsert
from vibralake.sources import pages, readings, tables


@pytest.fixture()
def csv(tmp_path):
    columns = ["id", "created_at", *reversed(domain.SENSORS), "fault"]
    lines = [",".join(columns)]
    for i, (time, fault, rpm) in enumerate(
        [("2026-06-01 21:32:53.911176+00:00", "cocked_rotor_2", "1000.0"), ("2026-05-01 00:00:00+00:00", "NA", "abc"),
         ("", "normal", "inf")]
    ):
        values = [rpm if c == "rpm" else "1.0" for c in reversed(domain.SENSORS)]
        lines.append(",".join([str(i), time, *values, fault]))
    path = tmp_path / "raw.csv"
    path.write_text("\n".join(lines))
    return str(path)


def test_preprocess(spark, csv):
    rows = {r["id"]: r for r in readings.preprocess(readings.scan_csv(spark, csv)).collect()}
    assert rows[0]["created_at"] == dt.datetime(2026, 6, 1, 21, 32, 53, 911176)
    assert rows[0]["fault_category"] == "cocked_rotor" and rows[0]["is_problem"]
    assert rows[1]["fault"] is None and rows[1]["fault_category"] == "desconhecido" and rows[1]["rpm"] == 0.0
    assert rows[2]["created_at"] is None and rows[2]["rpm"] == float("inf")
    assert rows[0]["total_vibration_energy"] == 4.0


def test_bad_time_raises_unless_lenient(spark, csv):
    raw = readings.scan_csv(spark, csv).selectExpr("*").withColumn("created_at", readings.F.lit("yesterday"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE_TIMESTAMP"):
        readings.preprocess(raw).collect()
    assert readings.preprocess(raw, strict_time=False).first()["created_at"] is None


def test_cache_and_ingest_guard(spark, csv, tmp_path):
    cache, stored = str(tmp_path / "cache"), str(tmp_path / "stored")
    first = readings.load_processed(spark, csv, cache)
    assert first.count() == 3
    assert readings.load_processed(spark, "/nowhere.csv", cache).count() == 3
    assert readings.ingest(first, stored) is True
    table = spark.read.parquet(stored)
    assert table.columns == list(domain.STORED_COLUMNS)
    assert table.filter("id = 0").first()["created_at"] == "2026-06-01 21:32:53.911176+00:00"
    assert {r["is_problem"] for r in table.collect()} == {0, 1}
    assert readings.ingest(first.limit(2), stored) is False
    assert readings.ingest(first.union(first), stored) is True
    assert spark.read.parquet(stored).count() == 6


def test_day_partitions_are_pruned(spark, csv, tmp_path):
    cache = str(tmp_path / "cache")
    readings.load_processed(spark, csv, cache)
    plan = spark.read.parquet(cache).filter("reading_date = date'2026-06-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(reading_date" in plan


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("Doc1.pdf", "text", 1)], "doc_name string, text string, n int")
    log = str(tmp_path / "log")
    assert tables.read_or_empty(spark, log, "n int").count() == 0
    tables.append(rows, log)
    tables.append(rows, log)
    assert tables.read_or_empty(spark, log, "n int").count() == 2
    a, b = tables.write_version(rows, str(tmp_path / "v")), tables.write_version(rows, str(tmp_path / "v"))
    assert a != b and spark.read.parquet(b).count() == 1
    tables.write_texts(rows, str(tmp_path / "texts"))
    assert spark.read.parquet(str(tmp_path / "texts")).first()["stem"] == "Doc1"
    tables.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["n"] == 1


def test_pages(spark, tmp_path):
    path = str(tmp_path / "pages")
    rows = [("Doc1.pdf", 0, "a", None), ("Note.pdf", 0, "b", None)]
    spark.createDataFrame(rows, "doc_name string, page_idx int, digital_text string, ocr_text string").write.parquet(path)
    assert [r["doc_name"] for r in pages.read_pages(spark, path).collect()] == ["Doc1.pdf"]


def test_broken_lines_are_set_apart(spark, tmp_path):
    lines = ["id,created_at,rpm,fault", "1,2024-01-01 00:00:00+00:00,5.5,polia", "x,2024-01-01,1,polia", "3,ontem,1,NA", "4,,abc,nan", "5,2024-01-01", "6,2024-01-01,1,polia,7", "y,ontem,,"]
    (tmp_path / "raw.csv").write_text("\n".join(lines))
    readings.write_checked(spark, str(tmp_path / "raw.csv"), str(tmp_path / "out"))
    rows = {r["record"].split(",")[0]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {i: (r["status"], r["errors"]) for i, r in rows.items()} == {
        "1": ("accepted", []), "x": ("refused", ["id"]), "3": ("refused", ["created_at"]), "4": ("accepted", []),
        "5": ("refused", ["columns"]), "6": ("refused", ["columns"]), "y": ("refused", ["id", "created_at"]),
    }
    assert rows["6"]["record"] == lines[6] and rows["3"]["record"] == lines[3]
    good = readings.accepted_rows(spark, str(tmp_path / "out"))
    assert sorted((r["id"], r["fault"]) for r in good.collect()) == [(1, "polia"), (4, None)]


def test_upsert_touches_only_its_folders(spark, tmp_path):
    import os

    path = str(tmp_path / "keyed")
    rows = spark.range(500).selectExpr("concat('k', id) AS key", "id AS value", "'old' AS text")
    upsert.write_keyed(rows, path, ["key"], 16)

    def files():
        return {(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}

    before = files()
    incoming = spark.createDataFrame([("k7", 7, "new"), ("k7", 8, "newer"), ("k900", 900, "added"), (None, 1, "none")], "key string, value long, text string")
    touched = upsert.upsert_keyed(spark, path, incoming, ["key"], ["value"], 16)
    assert 1 <= len(touched) <= 3
    changed = {d for d, _ in before ^ files()}
    assert changed == {f"{path}/bucket={b}" for b in touched}
    want = upsert.upsert(rows, incoming, ["key"], ["value"])
    got = upsert.read_keyed(spark, path)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert upsert.upsert_keyed(spark, path, incoming.limit(0), ["key"], [], 16) == []
