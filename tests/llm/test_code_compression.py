"""Codes of vectors: against brute force, and what the boxes leave to the kernel."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vibralake.llm import code_compression as cc
from vibralake.llm import queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, entries=16, parts=8, rounds=6):
    """(books, {position in rows: (code, error)}) by the definition, in plain integers."""
    kept = [
        (i, [math.floor(4096 * x) for x in v])
        for i, (_, v, _) in enumerate(rows)
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    if not kept:
        return [], {}
    ordered = sorted(kept, key=lambda r: (rows[r[0]][0] is None, rows[r[0]][0] or 0, r[1]))
    width = len(kept[0][1])
    edges = [j * width // parts for j in range(parts + 1)]
    books, out = [], {i: ["", 0] for i, _ in kept}
    for j in range(parts):
        subs = {i: v[edges[j] : edges[j + 1]] for i, v in kept}
        book = [subs[i] for i, _ in ordered[:entries]]

        def nearest(x, book):
            return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

        for _ in range(rounds):
            mine = {}
            for x in subs.values():
                mine.setdefault(nearest(x, book)[1], []).append(x)
            book = [[sum(c) // len(mine[e]) for c in zip(*mine[e], strict=True)] if e in mine else b for e, b in enumerate(book)]
        for i, x in subs.items():
            d, e = nearest(x, book)
            out[i][0] += f"{e:02x}"
            out[i][1] += d
        books.append(book)
    return books, out


def compared(spark, rows, monkeypatch, block=7):
    monkeypatch.setattr(cc, "BLOCK", block)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("row", "part", "code", "width", "id")})
    codes = cc.compress(table)
    books, want = brute(rows)
    got = sorted((r.id is None, r.id or 0, r.label is None, r.label or 0, r.code, r.error) for r in codes.rows.collect())
    assert got == sorted((rows[i][0] is None, rows[i][0] or 0, rows[i][2] is None, rows[i][2] or 0, c, e) for i, (c, e) in want.items())
    for width, made in codes.books.items():
        text = ",".join(str(x) for b in books for entry in b for x in entry)
        assert [b.tolist() for b in made] == books
        assert codes.digest(width) == hashlib.sha256(text.encode()).hexdigest()
    return codes


def test_equals_brute_force_with_odd_rows(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(16)], r.choice([1, 2, None])) for i in range(300)]
    rows += [(7, [r.gauss(0, 1) for _ in range(16)], 1), (None, [0.1] * 16, None), (None, [0.1] * 16, 2)]
    rows += [(3, None, 1), (900, [None] + [0.0] * 15, 1), (901, [math.nan] * 16, 1), (902, [math.inf] + [0.0] * 15, 2)]
    rows += [(1000 + i, [0.25, -0.25] * 8, 3) for i in range(150)]  # one vector in a third of the rows
    compared(spark, rows, monkeypatch)


def test_ties_and_unused_entries(spark, monkeypatch):
    rows = [(i, [float(i % 2)] * 8, 0) for i in range(40)]  # entries repeat: the lower of equals is taken, the others stay
    codes = compared(spark, rows, monkeypatch)
    assert {r.code for r in codes.rows.collect()} == {"00" * 8, "01" * 8}


def test_few_rows_odd_widths_and_empty_tables(spark, monkeypatch):
    compared(spark, [(i, [i / 7, 0.5, -i / 3, 0.0, 1.0], i) for i in range(5)], monkeypatch)  # 5 components in 8 parts
    compared(spark, [(1, [], None), (2, [], 4)], monkeypatch)
    empty = cc.compress(spark.createDataFrame([], SCHEMA))
    assert empty.rows.collect() == [] and empty.books == {}
    mixed = cc.compress(spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], SCHEMA))
    assert sorted((r.id, r.width, r.code, r.error) for r in mixed.rows.collect()) == [(1, 8, "00" * 8, 0), (2, 16, "00" * 8, 0)]
    with pytest.raises(ValueError):
        cc.compress(spark.createDataFrame([(1, [1e12] * 8, 1), (2, [0.0] * 8, 1)], SCHEMA))


def test_hilbert_neighbours_differ_in_one_step():
    for dims, bits in ((2, 4), (3, 3), (1, 5)):
        grid = np.indices((1 << bits,) * dims).reshape(dims, -1).T
        key = cc.hilbert(grid, bits)
        assert sorted(key.tolist()) == list(range(1 << (bits * dims)))
        walk = grid[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shortlists_hold_every_nearest_entry_and_prune():
    generator = np.random.default_rng(5)
    sizes = []
    for _ in range(200):
        book = generator.integers(-100, 100, (16, 3))
        values = generator.integers(-100, 100, 3) + generator.integers(0, 12, (40, 3))
        left = cc.shortlist(values.min(axis=0), values.max(axis=0), book)
        assert set(cc.nearest(values, book)[0].tolist()) <= set(left.tolist())
        sizes.append(len(left))
    assert np.mean(sizes) < 4


def test_blocks_with_one_entry_are_taken_whole(spark, monkeypatch):
    monkeypatch.setattr(cc, "BLOCK", 32)
    generator = np.random.default_rng(6)
    centres = generator.normal(0, 4, (16, 8))
    rows = [(i, (centres[i % 16] + generator.normal(0, 0.02, 8)).tolist(), 0) for i in range(2000)]
    table = spark.createDataFrame(rows, SCHEMA).select(F.col("vec_id").alias("row"), cc.integers("embedding", 4096).alias("v"))
    held = cc.blocks(table, 8, 1, cc.spans(table, 8))
    books = [np.floor(centres * 4096).astype(np.int64)]
    sizes = cc.shortlists(held, books).agg(F.avg(F.when(F.col("entries") == 1, 1).otherwise(0)).alias("whole")).first()
    assert sizes.whole > 0.5


def test_query_columns(spark, tmp_path):
    rows = [(i, [i / 50, 1.0] * 4, i % 3 or None) for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_code_compression(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    _, want = brute(rows)
    sums = {}
    for i, (_, e) in want.items():
        sums[rows[i][2]] = sums.get(rows[i][2], 0) + e
    assert {(r.vec_id, r.label_error) for r in got.collect()} == {(rows[i][0], sums[rows[i][2]]) for i in want}
