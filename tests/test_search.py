import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vibralake.operators import postings, search

WORDS = ["rolamento", "correia", "polia", "folga", "motor", "eixo", "vibração", "óleo", "alinhar", "trocar"]


def brute(queries, chunks, n):
    def counts(text):
        return Counter(w for w in re.findall(r"[^\W\d_]+", text.lower()))

    docs = {i: (counts(t), g) for i, t, g in chunks}
    df = Counter(b for c, _ in docs.values() for b in c)

    def vector(c):
        v = {b: tf * math.log((len(docs) + 1) / (df[b] + 1)) for b, tf in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {b: x / norm for b, x in v.items()} if norm else {}

    vectors = {i: (vector(c), g) for i, (c, g) in docs.items()}
    out = {}
    for q, text, group in queries:
        asked = vector(counts(text))
        scores = [
            (-round(sum(x * v.get(b, 0.0) for b, x in asked.items()), 9), i)
            for i, (v, g) in vectors.items() if group is None or g == group
        ]
        out[q] = [i for _, i in sorted(scores)[:n]]
    return out


def data(seed=3):
    rng = random.Random(seed)
    chunks = []
    for i in range(120):
        # Half of the collection is one text.
        text = "motor eixo" if i % 2 else " ".join(rng.choices(WORDS, k=rng.randrange(1, 12)))
        chunks.append((f"c{i:03d}", text, "hot" if i % 3 else "cold"))
    chunks.append(("empty", "123 456", "cold"))
    queries = [(i, " ".join(rng.choices(WORDS, k=3)), rng.choice(["hot", "cold", None])) for i in range(15)]
    queries.append((99, "nada disso", None))
    return queries, chunks


@pytest.mark.parametrize("few", [search.FEW_QUERIES, 4])
@pytest.mark.parametrize("grouped", [True, False])
def test_equals_brute_force(spark, monkeypatch, grouped, few):
    monkeypatch.setattr(search, "SHARD_BYTES", 700)
    monkeypatch.setattr(postings, "BLOCK", 3)
    queries, chunks = data()
    asked = spark.createDataFrame(queries, "query_id long, query_text string, fault_category string")
    rows = spark.createDataFrame(chunks, "chunk_id string, text string, fault_category string")
    group = "fault_category" if grouped else None
    index = search.build_index(rows.repartition(3), group=group)
    assert index.shards.count() > 5 and index.size == len(chunks)
    found = search.search(asked, index, 5, group=group, few=few)
    got: dict = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    assert got == brute([(q, t, g if grouped else None) for q, t, g in queries], chunks, 5)


def test_hits_carry_text(spark):
    rows = spark.createDataFrame([("a", "polia gasta"), ("b", "motor quente")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "polia")], "query_id long, query_text string")
    found = search.with_chunk_text(search.search(asked, search.build_index(rows), 1), rows).collect()
    assert [(r["chunk_id"], r["text"], r["rank"]) for r in found] == [("a", "polia gasta", 1)]
    assert found[0]["score"] == round(1 / math.sqrt(2), 3)


def test_words_never_share_a_term(spark):
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(5000)]
    rows = spark.createDataFrame([("a", " ".join(words)), ("b", "xyz")], "chunk_id string, text string")
    index = search.build_index(rows)
    assert index.terms.count() == len(set(words) | {"xyz"})


def test_long_queries_read_part_of_their_postings(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    rng = random.Random(5)
    rare = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(600)]
    chunks = [(f"c{i:05d}", " ".join(rng.choices(WORDS, k=12) + rng.choices(rare, k=4))) for i in range(3000)]
    rows = spark.createDataFrame(chunks, "chunk_id string, text string")
    # passages as they stand in the collection, with other words around them
    asked = spark.createDataFrame([(i, chunks[37 * i][1] + " " + " ".join(rng.choices(WORDS, k=40))) for i in range(20)], "query_id long, query_text string")
    index = search.build_index(rows)
    cost = search.search_cost(asked, index).collect()
    assert len(cost) == 20 and all(r["read"] < r["postings"] for r in cost)
    assert sum(r["read"] for r in cost) < 0.5 * sum(r["postings"] for r in cost)
    best = {r["query_id"]: r["item_id"] for r in search.search(asked, index, 1).collect()}
    assert best == {i: chunks[37 * i][0] for i in range(20)}


def test_impact_lists_and_block_maxima():
    keys, groups = pa.array(["b", "a", "c"]), pa.array([None, "g", "g"], pa.string())
    words = pa.array([["x", "y", "x"], ["y"], []], pa.list_(pa.string()))
    raw = postings.counted(keys, groups, words)
    assert raw["vocabulary"].to_pylist() == ["x", "y"] and raw["df"].to_pylist() == [1, 2]
    made = postings.weighed({n: raw[n] for n in ("bounds", "term", "tf")}, np.array([2.0, 1.0]))
    impact, posted = np.frombuffer(made["impact"]), np.frombuffer(made["posted"], np.int32)
    assert impact.tolist() == pytest.approx([4 / 17**0.5, 1 / 17**0.5, 1.0])
    assert posted.tolist() == [0, 1, 0]  # of y, item 1 has the greater impact
    assert np.frombuffer(made["block_max"]).tolist() == pytest.approx([4 / 17**0.5, 1.0])


def test_numeric_keys_odd_texts_and_empty_tables(spark):
    rows = spark.createDataFrame([(2, "motor eixo"), (1, None), (3, ""), (None, "motor"), (4, "motor motor")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "motor"), (2, None), (3, "???"), (None, "motor")], "query_id long, query_text string")
    got = search.search(asked, search.build_index(rows), 2).collect()
    assert {(r["query_id"], r["rank"], r["item_id"]) for r in got if r["query_id"] is not None} == {
        (1, 1, 4), (1, 2, 2), (2, 1, 1), (2, 2, 2), (3, 1, 1), (3, 2, 2)
    }
    empty = search.build_index(rows.limit(0))
    assert search.search(asked, empty, 2).collect() == [] and empty.size == 0
    assert search.search(asked.limit(0), search.build_index(rows), 2).collect() == []
