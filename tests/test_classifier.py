import pytest
from pyspark.sql import functions as F

from vibralake import domain
from vibralake.functions import arrays
from vibralake.operators import classifier


@pytest.fixture(scope="module")
def trained(spark):
    noise = (F.rand(3) - 0.5) * 0.2
    rows = spark.range(300).select(
        "id",
        ((F.col("id") % 3) + noise).alias("a"),
        (F.col("id") % 7).cast("double").alias("b"),
        F.lit(5.0).alias("c"),
        F.element_at(F.array(F.lit("polia"), F.lit("correia"), F.lit("normal")), (F.col("id") % 3 + 1).cast("int")).alias("fault_category"),
    )
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    forest = classifier.Forest(trees=8, depth=5)
    model, record = classifier.train_and_evaluate(rows, features=["a", "b", "c"], forest=forest)
    return rows, model, record.first()


def test_evaluation_record(trained):
    _, _, record = trained
    assert record["accuracy"] > 0.9 and record["f1_macro"] > 0.9
    assert record["test_samples"] == 60 and record["total_samples"] == 300
    assert record["classes"] == ["correia", "normal", "polia"]
    assert record["top_features"][0]["feature"] == "a"
    assert len(record["confusion_matrix"]) == 9 and len(record["classification_report"]) == 3


def test_scoring_keeps_unlabelled_rows(spark, trained):
    rows, model, _ = trained
    events = rows.drop("fault_category").limit(5).unionByName(
        spark.createDataFrame([(1000, float("inf"), 1.0, 5.0)], "id long, a double, b double, c double")
    )
    scored = classifier.score(model, events).collect()
    assert len(scored) == 6
    for r in scored:
        assert 0.0 <= r["confidence"] <= 100.0
        assert r["predicted_category"] == max(r["probabilities"], key=r["probabilities"].get)
        assert len(r["top_probabilities"]) == 3


def test_save_and_load(spark, trained, tmp_path):
    rows, model, _ = trained
    classifier.save(model, str(tmp_path / "model"))
    again = classifier.load(str(tmp_path / "model"))
    want = {r["id"]: r["predicted_category"] for r in classifier.score(model, rows).collect()}
    assert {r["id"]: r["predicted_category"] for r in classifier.score(again, rows).collect()} == want
    assert classifier.importance_frame(spark, again, ["a", "b", "c"]).first()["feature"] == "a"


def test_defaults():
    assert classifier.Forest() == (100, 20, 2, 42)
    assert len(domain.FEATURES) == 32


def test_first_maximum_wins(spark):
    row = spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>").select(
        arrays.argmax(F.col("p")).alias("i"),
        arrays.confidence(F.col("p")).alias("c"),
        arrays.top_probabilities(F.array(F.lit("b"), F.lit("a"), F.lit("c")), F.col("p"), 2).alias("t"),
    ).first()
    assert row["i"] == 0 and row["c"] == 40.0
    assert [t["label"] for t in row["t"]] == ["b", "a"]
