"""Mixing, packing and tool calls: exact sums, best bounds, odd rows."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vibralake.llm import mixing, packing, tool_calls

DOCS = "doc_id long, text string, source string"


def brute_targets(sizes, share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def test_mix_meets_targets_and_agrees_on_rerun(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "BUCKET", 100)
    r = random.Random(2)
    sources = ["b", "a", "Z", "é", "", None]
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), sources[min(int(r.expovariate(1)), 5)]) for i in range(3000)]
    rows += [(9001, None, "a"), (9002, " \t", None), (9002, "x y", "a"), (9003, "w " * 5000, "b"), (None, "q", "b")]
    table = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("size", "target", "base", "part")})
    got = mixing.mix(table).collect()
    sizes, taken = {}, {}
    for x in got:
        sizes[x.source] = sizes.get(x.source, 0) + x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
        assert x.taken in (0, x.size, 2 * x.size) and x.taken == x.copies * x.size
    assert len(got) == len(rows)
    want = brute_targets(sizes)
    for x in got:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(y.size for y in got if y.source == s)
    again = mixing.mix(table.repartition(7))
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_every_document_keeps_its_expected_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    rows = [(i, "w " * (1 + i % 5), "a") for i in range(100)] + [(1000 + i, "w", "b") for i in range(900)]
    table = spark.createDataFrame(rows, DOCS)
    total = np.zeros(5)
    for seed in range(4):
        monkeypatch.setattr(mixing, "SEED", seed)
        for x in mixing.mix(table, share=0.3).filter("source = 'b'").collect():
            total[x.doc_id % 5] += x.copies
    assert total.sum() == pytest.approx(total.mean() * 5) and (np.abs(total / total.mean() - 1) < 0.35).all()


def test_mix_without_words_or_rows(spark):
    table = spark.createDataFrame([(1, None, "a"), (2, "", None)], DOCS)
    assert sorted((r.doc_id, r.taken, r.target) for r in mixing.mix(table).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]
    assert mixing.mix(table.limit(0)).count() == 0
    clashing = table.withColumns({c: F.lit(1) for c in ("_id", "copies", "size", "_times")})
    assert mixing.copies(clashing).columns == clashing.columns


def test_bounds_are_the_best():
    r = random.Random(3)
    for _ in range(40):
        lengths = np.array(sorted(r.sample(range(1, 60), r.randint(1, 9))), np.int64)
        counts = np.array([r.randint(1, 20) for _ in lengths], np.int64)
        k = r.randint(1, 5)

        def waste(bounds, lengths=lengths, counts=counts):
            return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths.tolist(), counts.tolist(), strict=True))

        got = packing.best_bounds(lengths, counts, k)
        choices = itertools.combinations(lengths[:-1].tolist(), min(k, len(lengths)) - 1)
        assert waste(got) == min(waste([*c, int(lengths[-1])]) for c in choices)
        assert len(got) == min(k, len(lengths)) and got == sorted(set(got))
    assert packing.best_bounds(np.zeros(0, np.int64), np.zeros(0, np.int64), 3) == []


def test_batches_are_full_and_hold_every_token(spark):
    r = random.Random(5)
    rows = [(i, "w " * r.choice([1, 7, 7, 7, 7, 30, r.randint(1, 90)]), "a") for i in range(700)]
    rows += [(800, None, "a"), (801, " ", "a"), (802, "w " * 1001, "a"), (5, "w w w", "a"), (5, "w w w", "a"), (None, "w", "a")]
    table = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("piece", "place", "n_tokens", "bucket")})
    got = packing.pack(table, window=64, buckets=5, budget=640).collect()
    assert sum(x.n_tokens for x in got) == sum(len((t or "").split()) for _, t, _ in rows)
    batches = {}
    for x in got:
        batches.setdefault((x.bucket, x.bucket_length), {}).setdefault(x.batch, []).append(x.slot)
        assert 0 <= x.padding == x.bucket_length - x.n_tokens
    assert len(batches) == 5
    for (_, length), held in batches.items():
        assert sorted(held) == list(range(len(held)))
        for batch, slots in held.items():
            assert sorted(slots) == list(range(len(slots))) and len(slots) * length <= 640
            assert len(slots) == 640 // length or batch == len(held) - 1
    assert packing.pack(table.limit(0)).count() == 0


CALLS = "conv_id long, turn long, call_id string, parent_id string, name string, arguments string"
RESULTS = "conv_id long, turn long, call_id string, content string"
SCHEMAS = "name string, fields array<struct<field:string,kind:string,required:boolean>>"


def linked(spark, calls, results):
    schemas = spark.createDataFrame([("find", [("q", "string", True), ("n", "number", False), ("deep", "object", False)])], SCHEMAS)
    rows = tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), schemas).collect()
    return {(r.conv_id, r.call_id, r.status): r for r in rows}, rows


def test_calls_are_linked_ordered_and_checked(spark):
    calls = [
        (1, 5, "c", "b", "find", '{"q": "é\\n", "n": 2.5, "deep": {"z": 1, "a": [1, 2]}}'),
        (1, 3, "a", None, "find", '{"q": "x"}'),
        (1, 4, "b", "a", "find", '{"n": "no"}'),
        (1, 9, "b", "a", "find", "{}"),
        (1, 6, "x", "y", "find", '{"q": "s", "k": 1}'),
        (1, 7, "y", "x", "other", "{}"),
        (2, 1, "a", "gone", "find", "nonsense"),
        (2, 2, None, None, "find", "{}"),
        (None, 1, "a", None, "find", "{}"),
    ]
    results = [(1, 8, "c", "done"), (1, 9, "c", "again"), (1, 8, "q", "lost"), (2, 3, "a", None), (2, 4, None, "z")]
    got, rows = linked(spark, calls, results)
    assert got[1, "c", "linked"].depth == 2 and got[1, "a", "open"].depth == 0 and got[1, "b", "open"].depth == 1
    assert got[1, "x", "open"].depth is None and got[1, "y", "open"].depth is None
    assert got[1, "c", "linked"].json == '{"arguments":{"deep":{"a":[1,2],"z":1},"n":2.5,"q":"é\\n"},"id":"c","name":"find","result":"done"}'
    assert json.loads(got[1, "a", "open"].json)["result"] is None
    assert got[1, "b", "open"].errors == ["missing q", "type n"]
    assert got[1, "x", "open"].errors == ["unknown k"] and got[1, "y", "open"].errors == ["unknown tool"]
    assert got[2, "a", "linked"].errors == ["arguments are no object"] and got[2, "a", "linked"].depth == 0
    status = sorted(r.status for r in rows)
    assert status == sorted(["linked"] * 2 + ["open"] * 4 + ["repeated"] * 2 + ["orphan"] + ["unnamed"] * 3)


def test_a_long_chain_of_calls(spark):
    calls = [(7, i, f"c{i}", f"c{i - 1}", "find", "{}") for i in range(1, 70)]
    got, _ = linked(spark, calls, [])
    assert [got[7, f"c{i}", "open"].depth for i in range(1, 70)] == list(range(69))


def test_no_calls(spark):
    assert linked(spark, [], [])[1] == []
