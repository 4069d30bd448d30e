"""The stored index against a search of all rows, and what it reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vibralake.operators import similarity, similarity_index

SCHEMA = "id long, features array<double>"


def table(spark, n=900, groups=12, seed=0):
    generator = np.random.default_rng(seed)
    centres = generator.normal(0, 1, (groups, 6))
    rows = [(i, (centres[i % groups] + generator.normal(0, 0.03, 6)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(found):
    return sorted((r["query_id"], r["rank"], r["item_id"], round(r["score"], 7)) for r in found.collect())


def test_equals_a_search_of_all_rows(spark, tmp_path):
    history = table(spark).unionByName(spark.createDataFrame([(5000, None), (5001, [1.0, None, 0.0, 0.0, 0.0, 0.0])], SCHEMA))
    similarity_index.build(history, str(tmp_path / "index"), pivots=20)
    index = similarity_index.load(spark, str(tmp_path / "index"))  # as a later job finds it
    assert index.sizes.sum() == 900 and index.vectors.count() == 900
    mean = index.scale.mean
    events = table(spark, 40, seed=3).unionByName(spark.createDataFrame([(77, mean), (78, None)], SCHEMA))  # one without direction
    want = plain(similarity.nearest(events, history, 7))
    assert plain(similarity_index.search(events, index, 7)) == want
    assert plain(similarity_index.search(events, index, 7, few=5)) == want
    with pytest.raises(ValueError):
        similarity_index.search(events, index, 901)
    assert similarity_index.search(events.limit(0), index, 7).collect() == []


def test_reads_only_the_cells_it_needs(spark, tmp_path):
    history = table(spark)
    index = similarity_index.build(history, str(tmp_path / "index"), pivots=30)
    one = history.filter("id = 5")
    row = similarity.unit_rows(np.array([one.first()["features"]]), index.scale)
    cells = similarity_index.around(index, similarity_index.angles(index, row), 10)
    assert 1 <= cells.sum() <= 3
    wanted = similarity_index.rows_of(index, index.cells[cells])
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("PartitionFilters: [isnotnull(cell", "PartitionFilters: [cell")
    files = {f for (f,) in wanted.select(F.input_file_name()).distinct().collect()}
    every = {f for (f,) in index.vectors.select(F.input_file_name()).distinct().collect()}
    assert len(files) <= 3 < len(every)
    assert [r["item_id"] for r in similarity_index.search(one, index, 1).collect()] == [5]


def test_rows_without_direction(spark, tmp_path):
    rows = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(4)] + [(9, [1.0, 1.0])], SCHEMA)  # all at the mean
    index = similarity_index.build(rows, str(tmp_path / "index"))
    assert index.cells.tolist() == [similarity_index.NO_DIRECTION]
    got = similarity_index.search(rows.filter("id = 9"), index, 3)
    assert [(r["item_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(0, 0.0), (1, 0.0), (2, 0.0)]
