"""Quality, toxicity and search: accuracy on unseen rows, exactness, odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from vibralake.llm import quality, topk_search, toxicity

ODD = [None, "", " \n ", "a", "!!! ???", "word " * 5000, "é" * 30000]


def corpus(spark, seed, n=400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(600)]
    rows, labels = [], []
    for i in range(n):
        text = [r.choice(vocabulary) for _ in range(r.randint(10, 200))]
        good, toxic = int(r.random() < 0.7), int(r.random() < 0.3)
        if toxic:
            for _ in range(3):
                text.insert(r.randrange(len(text)), r.choice(["vileword", "vileness", "nastyone"]))
        if not good:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, good, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumn("label", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, column, threshold, folds, held):
    rows = scored.join(labels, "doc_id").filter(quality.fold("doc_id", folds) == held).select("score", column).collect()
    assert len(rows) > 30
    return np.mean([(r.score >= threshold) == (r[column] == 1) for r in rows])


def test_quality_on_held_out_rows(spark):
    docs, labels = corpus(spark, 1)
    model = quality.fit(docs, labels)
    assert accuracy(quality.score(docs, model), labels, "quality", 0.7, 4, 2) > 0.97
    again = quality.fit(docs.orderBy("text"), labels.unionAll(labels))
    assert np.allclose(again.out, model.out)


def test_quality_odd_rows_and_missing_labels(spark):
    docs, labels = corpus(spark, 1, 60)
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "x y")], "doc_id long, text string")
    model = quality.fit(docs, labels)
    scores = [r.score for r in quality.score(odd, model).collect()]
    assert len(scores) == len(ODD) + 1 and all(0 <= s <= 1 for s in scores)
    assert len(set(scores[:3])) == 1
    assert quality.fit(docs, labels.filter("quality = 1")) is None
    assert {r.score for r in quality.score(odd, None).collect()} == {0.5}
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(odd.limit(0), model).count() == 0


def test_gradients_of_the_attention_model():
    generator = np.random.default_rng(0)
    features, first = generator.normal(size=(12, 5)), np.array([0, 3, 4, 9, 12])
    model = quality.fit_arrays(features, first, np.array([1.0, 0, 1, 0]), np.ones(4))
    weight = quality.forward(model, quality.encoded(model, features), first)["weight"]
    assert np.allclose(np.add.reduceat(weight, first[:-1]), 1)
    score = quality.forward(model, quality.encoded(model, features), first)["score"]
    assert ((score > 0.5) == np.array([True, False, True, False])).all()


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark, 2)
    model = toxicity.fit(docs, labels)
    found = toxicity.passages(docs, model)
    assert accuracy(found, labels, "toxic", 0.5, 5, 0) > 0.97
    unseen = spark.createDataFrame([(1, "abc vilest thing vilely"), (2, "abc def"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity.passages(unseen, model).collect()}
    assert rows[1].score > 0.5 > rows[2].score and len(rows[1].passages) >= 1 and rows[1].passages[0].first_word == 1
    assert rows[3].score == rows[2].score and rows[3].passages == []


def test_toxicity_odd_rows(spark):
    docs, labels = corpus(spark, 2, 60)
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    model = toxicity.fit(docs, labels)
    assert all(0 <= r.score <= 1 for r in toxicity.passages(odd, model).collect())
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert toxicity.passages(odd, None).count() == len(ODD)


def brute_segments(scores):
    """Maximal scoring segments by their definition, splitting at the best segment again and again."""
    out = []

    def split(a, b):
        sums = np.concatenate([[0], np.cumsum(scores[a:b])])
        best = max(((sums[j] - sums[i], -(j - i), -i, j) for i in range(b - a) for j in range(i + 1, b - a + 1)), default=None)
        if best is None or best[0] <= 0:
            return
        i, j = -best[2], best[3]
        out.append((a + i, a + j))
        split(a, a + i)
        split(a + j, b)

    split(0, len(scores))
    return sorted(out)


def test_segments_take_time_in_proportion():
    import time

    def seconds(n, drift):
        scores = np.tile([1.0, -1.0 - drift], n)
        began = time.process_time()
        rows, _, _, score = toxicity.segments(scores, np.array([0, 2 * n]))
        assert len(rows) == n and (score == 1.0).all()
        return time.process_time() - began

    for drift in (0.5, 0.0):  # sums that fall, and that stay
        assert seconds(400_000, drift) < 20 * max(seconds(40_000, drift), 0.05)


def test_segments_against_their_definition():
    generator = np.random.default_rng(4)
    for _ in range(60):
        a, b = generator.normal(-0.3, 1, 25), generator.normal(-0.3, 1, 14)
        rows, first, end, score = toxicity.segments(np.concatenate([a, b]), np.array([0, 25, 25, 39]))
        assert [(x, y) for r, x, y in zip(rows, first, end, strict=True) if r == 0] == brute_segments(a)
        assert [(x - 25, y - 25) for r, x, y in zip(rows, first, end, strict=True) if r == 2] == brute_segments(b)


def brute_topk(vectors, k):
    fine = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in fine:
        if q % 20 == 0:
            found = sorted((-int(a @ b), i) for i, b in fine if i != q and len(b) == len(a))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


def vectors_of(kind, n=900):
    generator = np.random.default_rng(8)
    if kind == "skewed":  # a few large values, for which the bound stops early
        rows = generator.exponential(1, (n, 6)) ** 3
    elif kind == "ties":
        rows = generator.integers(-1, 2, (n, 3)) / 4
    else:
        rows = generator.normal(0, 0.2, (n, 16))
    return [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(rows)]


def test_topk_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD", 200)
    monkeypatch.setattr(topk_search, "QUERIES", 8)
    for kind in ("skewed", "ties", "plain"):
        vectors = vectors_of(kind)
        vectors += [(2000, None), (2020, [None, 1.0]), (2040, [float("nan")] * 3), (2060, [])]
        table = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<float>, score string, rank int")
        rows = topk_search.integer_vectors(table)
        got = topk_search.search(rows.filter("id % 20 = 0"), rows, 7)
        assert {tuple(r) for r in got.collect()} == brute_topk(vectors, 7)


def test_topk_of_few_and_no_rows(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    rows = topk_search.integer_vectors(table)
    assert [tuple(r) for r in topk_search.search(rows.filter("id = 0"), rows, 5).collect()] == [(0, 1, 1, 8192)]
    assert topk_search.search(rows.limit(0), rows.limit(0), 5).count() == 0


def test_threshold_stops_before_the_end():
    vectors = vectors_of("skewed", 4000)
    ids = np.array([i for i, _ in vectors])
    matrix = np.floor(64 * np.array([v for _, v in vectors])).astype(np.int64)
    shard = topk_search.Shard(ids, matrix)
    depth, query = 64, np.array([[1, 0, 0, 0, 0, 0]])
    assert shard.bound(query.astype(float), depth)[0] < np.sort(matrix @ query[0])[-5]
