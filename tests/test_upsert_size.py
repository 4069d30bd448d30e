"""A keyed table is compressed well and an upsert lays it down without many small files."""

from pathlib import Path

import pyarrow.parquet as pq

from vibralake.operators import upsert


def test_upsert_keyed_is_small(spark, tmp_path):
    rows = spark.range(3_000).selectExpr("cast(id as string) AS k", "repeat(cast(id as string), 20) AS text")
    path = str(tmp_path / "table")
    upsert.write_keyed(rows, path, ["k"], buckets=4)
    twice = rows.filter("cast(k as int) % 2 = 0").selectExpr("k", "concat('new ', text) AS text")
    upsert.upsert_keyed(spark, path, twice.unionByName(twice), ["k"], ["text"], buckets=4)
    got = {r.k: r.text for r in upsert.read_keyed(spark, path).collect()}
    assert len(got) == upsert.read_keyed(spark, path).count() == 3_000
    assert all(v == ("new " if int(k) % 2 == 0 else "") + k * 20 for k, v in got.items())
    files = list(Path(path).rglob("*.parquet"))
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
