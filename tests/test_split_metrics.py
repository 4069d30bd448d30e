import hashlib
import math

import pytest
from pyspark.sql import functions as F

from vibralake.operators import evaluation, split

# Published test counts, rows true, columns predicted.
CLASSES = [
    "cocked_rotor", "correia", "desalinhamento", "desbalanceamento", "eccentric_rotor", "falta_de_fase", "normal",
    "outro_defeito", "polia", "rolamento_combinado", "rolamento_elementos_rolantes", "rolamento_pista_externa",
    "rolamento_pista_interna", "ventoinha",
]
MATRIX = [
    [2292, 53, 27, 60, 100, 0, 35, 0, 59, 36, 20, 96, 27, 50],
    [40, 2221, 87, 8, 24, 0, 17, 0, 1, 0, 0, 2, 0, 0],
    [9, 12, 1728, 7, 31, 0, 12, 0, 16, 0, 1, 0, 2, 18],
    [51, 16, 25, 2331, 46, 0, 67, 0, 23, 2, 2, 13, 2, 49],
    [170, 87, 80, 81, 2566, 0, 58, 0, 48, 6, 23, 37, 20, 123],
    [1, 0, 0, 0, 0, 149, 5, 0, 0, 2, 2, 1, 0, 0],
    [90, 43, 168, 75, 109, 4, 2440, 4, 45, 6, 48, 66, 3, 55],
    [0, 0, 0, 0, 0, 0, 0, 20, 0, 0, 0, 0, 0, 0],
    [35, 10, 32, 34, 43, 0, 15, 0, 2124, 26, 18, 4, 20, 39],
    [42, 0, 5, 4, 10, 0, 5, 0, 77, 2407, 122, 137, 90, 11],
    [58, 3, 10, 4, 24, 0, 11, 0, 46, 96, 2243, 158, 75, 13],
    [75, 10, 14, 22, 16, 0, 41, 0, 24, 49, 91, 2498, 83, 30],
    [21, 7, 21, 5, 21, 0, 4, 0, 41, 87, 64, 116, 3150, 6],
    [68, 22, 90, 35, 122, 1, 36, 0, 85, 1, 40, 22, 6, 1932],
]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(CLASSES[i], CLASSES[j], n) for i, line in enumerate(MATRIX) for j, n in enumerate(line) if n]
    return spark.createDataFrame(rows, "label string, prediction string, n long")


def test_published_summary(pairs):
    row = evaluation.metric_summary(evaluation.class_report(pairs)).first()
    assert row["accuracy"] == pytest.approx(0.8423561151079136, abs=1e-12)
    assert row["f1_macro"] == pytest.approx(0.854423678715043, abs=1e-12)
    assert row["f1_weighted"] == pytest.approx(0.8421979449742786, abs=1e-12)
    assert row["precision_macro"] == pytest.approx(0.8491824273285176, abs=1e-12)
    assert row["recall_macro"] == pytest.approx(0.8635525533279621, abs=1e-12)
    assert row["precision_weighted"] == pytest.approx(0.8447786702334656, abs=1e-12)
    assert row["support"] == 33360


def test_published_report(pairs):
    report = {r["class"]: r for r in evaluation.class_report(pairs).collect()}
    assert report["cocked_rotor"]["precision"] == pytest.approx(0.7764227642276422, abs=1e-12)
    assert report["cocked_rotor"]["f1"] == pytest.approx(0.7893921129671087, abs=1e-12)
    assert report["outro_defeito"]["recall"] == 1.0
    assert report["ventoinha"]["support"] == 2460


def test_dense_matrix(pairs):
    found = {(r["label"], r["prediction"]): r["n"] for r in evaluation.confusion_matrix(pairs).collect()}
    assert len(found) == 196
    assert found["outro_defeito", "normal"] == 0 and found["polia", "polia"] == 2124
    wide = {r["label"]: r for r in evaluation.confusion_wide(pairs, CLASSES).collect()}
    assert [wide["normal"][c] for c in CLASSES] == MATRIX[6]


def test_empty_class_counts_as_zero(spark):
    pairs = spark.createDataFrame([("a", "b", 1)], "label string, prediction string, n long")
    report = {r["class"]: r for r in evaluation.class_report(pairs).collect()}
    assert report["a"]["precision"] == report["b"]["recall"] == report["a"]["f1"] == 0.0


@pytest.fixture(scope="module")
def rows(spark):
    # One class holds most rows.
    data = [(i, "hot" if i % 10 else ("a" if i % 20 else "b")) for i in range(3001)] + [(9999, None)]
    return spark.createDataFrame(data, "id long, c string")


def test_split_equals_ranking(rows):
    marked = split.stratified_split(rows, "c", "id").collect()
    assert len(marked) == 3002
    by_class: dict = {}
    for r in marked:
        by_class.setdefault(r["c"], []).append((hashlib.md5(f"{r['id']}|42".encode()).hexdigest(), r["is_test"]))
    assert sum(r["is_test"] for r in marked) == math.ceil(0.2 * 3002)
    for entries in by_class.values():
        entries.sort()
        taken = [t for _, t in entries]
        assert taken == sorted(taken, reverse=True)
        assert abs(sum(taken) - 0.2 * len(taken)) <= 1


def test_class_weights(rows):
    found = {r["c"]: r["weight"] for r in split.class_weights(rows.filter("c is not null"), "c").collect()}
    counts = {r["c"]: r["count"] for r in rows.groupBy("c").count().collect()}
    assert found["hot"] == pytest.approx(3001 / (3 * counts["hot"]))
