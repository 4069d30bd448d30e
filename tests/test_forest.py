"""The forest: against a plain recursive tree, its limits, and independence of the deal of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vibralake.operators import classifier, forest

SCHEMA = "id long, a double, b double, c double, d double, fault_category string"


def plain_tree(bins, labels, counts, weights, limits, tree, node=1):
    """The same tree one node at a time, in loops."""
    classes = [int(counts[labels == k].sum()) for k in range(limits.classes)]
    level = node.bit_length() - 1
    leaf = [(tree, node, -1, -1, classes)]
    if len(bins) < limits.split_rows or sum(c > 0 for c in classes) < 2 or level >= limits.depth:
        return leaf
    order = forest.feature_order(tree, np.array([node]), limits.width, limits.seed)[0]

    def purity(mine):
        held = [float((counts[mine] * (labels[mine] == k)).sum() * weights[k]) for k in range(limits.classes)]
        return sum(x * x for x in held) / sum(held) if sum(held) else 0.0

    for start in range(0, limits.width, limits.tried):
        best = None
        for f in order[start : start + limits.tried]:
            for cut in range(forest.BINS):
                left = bins[:, f] <= cut
                if left.sum() < limits.leaf_rows or (~left).sum() < limits.leaf_rows:
                    continue
                gain = purity(left) + purity(~left) - purity(np.ones(len(bins), bool))
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, int(f), cut, left)
        if best:
            _, f, cut, left = best
            out = [(tree, node, f, cut, classes)]
            for side, child in ((left, 2 * node), (~left, 2 * node + 1)):
                out += plain_tree(bins[side], labels[side], counts[side], weights, limits, tree, child)
            return out
    return leaf


@pytest.mark.parametrize("tree", [0, 1, 2])
def test_equals_a_plain_tree(tree):
    generator = np.random.default_rng(tree)
    bins = generator.integers(0, 6, (120, 5)).astype(np.uint8)
    bins[:, 3] = 2  # one feature never splits
    labels = (bins[:, 0] // 2 + (generator.random(120) < 0.2)) % 3
    counts = generator.integers(1, 4, 120)
    limits = forest.Limits(3, 5, 6, 2, 5, 42)
    weights = forest.balanced(np.bincount(labels, counts, minlength=3)[None, :])[0]
    got = forest.grown(tree, 1, bins, labels, counts, weights, limits)
    want = plain_tree(bins, labels, counts, weights, limits, tree)
    assert sorted((t, n, f, c, k) for t, n, f, c, _, k in got) == sorted(want)


def table(spark, n=900):
    generator = np.random.default_rng(1)
    y = generator.choice(3, n, p=[0.7, 0.2, 0.1])
    x = generator.normal(0, 1, (n, 4))
    x[:, 0] += 2.5 * y
    x[:, 1] -= 2.5 * (y == 1)
    rows = [(i, *map(float, v), f"class_{k}") for i, (v, k) in enumerate(zip(x, y.tolist(), strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


FEATURES = ["a", "b", "c", "d"]


def nodes(model):
    return model.nodes.to_pylist()


def test_passes_over_all_rows_give_the_same_forest(spark, monkeypatch):
    rows = table(spark)
    small = classifier.Forest(trees=4, depth=6)
    whole = classifier.train(rows, FEATURES, forest=small)
    monkeypatch.setattr(forest, "LOCAL_ROWS", 60)  # upper levels by Spark aggregations, the rest in groups
    monkeypatch.setattr(forest, "PASS_CELLS", 3 * 2 * forest.BINS * 3)  # three nodes a pass
    dealt = classifier.train(rows.repartition(5), FEATURES, forest=small)
    assert len(nodes(whole)) > 60
    for mine, other in zip(nodes(whole), nodes(dealt), strict=True):
        assert {k: v for k, v in mine.items() if k != "gain"} == {k: v for k, v in other.items() if k != "gain"}
        assert mine["gain"] == pytest.approx(other["gain"])
    monkeypatch.setattr(forest, "LOCAL_ROWS", 0)  # every node by a pass
    alone = classifier.train(rows, FEATURES, forest=small._replace(depth=2))
    monkeypatch.undo()
    grouped = classifier.train(rows, FEATURES, forest=small._replace(depth=2))
    assert [(n["node"], n["feature"], n["bin"], n["counts"]) for n in nodes(alone)] == [(n["node"], n["feature"], n["bin"], n["counts"]) for n in nodes(grouped)]


def test_bootstrap_and_class_weights():
    rows = np.random.default_rng(0).integers(-(2**62), 2**62, 200_000)
    times = forest.drawn(rows, 3, 42)
    assert abs(times.mean() - 1) < 0.02 and abs((times == 0).mean() - np.exp(-1)) < 0.01
    assert (times == forest.drawn(rows, 3, 42)).all() and (times != forest.drawn(rows, 4, 42)).any()
    weights = forest.balanced(np.array([[10, 30, 0], [5, 5, 10]]))
    assert weights.tolist() == [pytest.approx([2.0, 2 / 3, 0.0]), pytest.approx([4 / 3, 4 / 3, 2 / 3])]


def test_separable_classes_and_rare_ones(spark):
    rows = table(spark, 3000)
    model, record = classifier.train_and_evaluate(rows, features=FEATURES, forest=classifier.Forest(trees=30, depth=12))
    one = record.first()
    assert one["accuracy"] > 0.85 and one["recall_macro"] > 0.75
    assert [x["feature"] for x in one["top_features"][:2]] == ["a", "b"] or one["top_features"][0]["feature"] in ("a", "b")
    held = model.probabilities(np.array([[0.0, 0.0, 0.0, 0.0], [5.0, 0.0, np.inf, np.nan]]))
    assert held.sum(axis=1).tolist() == pytest.approx([1.0, 1.0]) and held.argmax(axis=1).tolist() == [0, 2]
    assert model.importances().sum() == pytest.approx(1.0)


def test_leaves_keep_their_limits(spark):
    model = classifier.train(table(spark), FEATURES, forest=classifier.Forest(trees=3, depth=4, leaf_rows=40), split_rows=200)
    levels = [n["node"].bit_length() - 1 for n in nodes(model)]
    assert max(levels) <= 4 and all(sum(n["counts"]) >= 40 for n in nodes(model))
    assert all(sum(n["counts"]) >= 200 for n in nodes(model) if n["feature"] >= 0)


def test_odd_rows(spark):
    rows = table(spark, 100).unionByName(spark.createDataFrame([(1000, None, float("nan"), float("inf"), 0.0, None), (1001, 1.0, None, 0.0, 0.0, "class_0")], SCHEMA))
    model = classifier.train(rows, FEATURES, forest=classifier.Forest(trees=3, depth=3))
    assert model.classes == ["class_0", "class_1", "class_2"]
    assert classifier.score(model, rows).count() == 102
    with pytest.raises(ValueError):
        classifier.train(rows.limit(0), FEATURES)
    single = classifier.train(rows.filter("fault_category = 'class_0'"), FEATURES, forest=classifier.Forest(trees=2, depth=3))
    assert {r["confidence"] for r in classifier.score(single, rows).collect()} == {100.0}
    assert single.importances().tolist() == [0.0] * 4


def test_importance_of_a_registered_query(spark):
    import os

    import __spark_entry__ as entry_points

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("test tables are not here")
    found = entry_points.queries()["feature_importance"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == 10 and all(0 < r["importance"] < 1 for r in found)
    assert [r["importance"] for r in found] == sorted((r["importance"] for r in found), reverse=True)


def test_hashes_follow_all_columns(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0, "x"), (2, 1.0, 2.0, 3.0, 4.0, "x")], SCHEMA)
    assert rows.select(F.xxhash64(*rows.columns)).distinct().count() == 2
