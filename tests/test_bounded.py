"""What a task holds stays bounded when tables grow."""

from pathlib import Path

import pyarrow.parquet as pq

from vibralake.operators import postings, search


def test_a_task_holds_one_shard_of_the_index(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_BYTES", 2_000)
    rows = spark.range(400).selectExpr("cast(id as string) AS chunk_id", "concat('motor ', repeat('eixo ', cast(id % 7 AS int)), 'polia') AS text").coalesce(1)
    index = search.build_index(rows)
    files = [pq.ParquetFile(Path(f.removeprefix("file:"))) for f in index.shards.inputFiles()]
    groups = [f.metadata.row_group(i).num_rows for f in files for i in range(f.metadata.num_row_groups)]
    assert len(groups) > 5 and set(groups) == {1}
    # no posting has its impact written twice
    assert {"impact", "posted_impact"}.isdisjoint(index.shards.columns) and set(postings.STORED) <= set(index.shards.columns)


def test_a_scoring_task_holds_a_small_forest(spark):
    import pickle

    import numpy as np

    from vibralake.operators import forest

    rng = np.random.default_rng(1)
    x = rng.normal(size=(1_500, 4))
    rows = spark.createDataFrame([(*map(float, r), f"c{i % 10}") for i, r in enumerate(x)], "a double, b double, c double, d double, label string")
    model = forest.fit(rows, ["a", "b", "c", "d"], "label", 5, 20, 2, 5, 3)
    assert model.nodes.num_rows > 2_000
    # what is sent to a worker: node numbers, children and all classes' shares took over 200 bytes a node
    assert len(pickle.dumps(model.opened())) < 40 * model.nodes.num_rows
    # the draws of the leaves are those of the nodes
    tree = model.nodes["tree"].to_numpy() == 0
    counts = np.array(model.nodes["counts"].to_pylist())[tree & (model.nodes["feature"].to_numpy() < 0)]
    assert (model.opened().trees[0].drawn(np.arange(len(counts)), 10) == counts).all()


def test_a_task_holds_few_angles_at_once():
    import pyarrow as pa

    from vibralake.operators import similarity

    batch = pa.record_batch({"id": pa.array(range(10_000))})
    parts = list(similarity._blocks([batch], 4_096))
    # ten thousand rows against all pivots were 328 MB of angles, several times over
    assert max(p.num_rows for p in parts) * 4_096 <= similarity.BLOCK_ANGLES
    assert pa.Table.from_batches(parts)["id"].to_pylist() == list(range(10_000))
    assert len(list(similarity._blocks([batch], 0))) == 1
