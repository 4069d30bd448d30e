"""The far search of similarity sends an event once to each piece of cells, not once to each cell."""

import numpy as np

from vibralake.operators import similarity, topk


def test_events_travel_by_piece(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PIVOTS", 64)
    sent = []
    plain = topk.grid
    monkeypatch.setattr(topk, "grid", lambda queries, items, *a, **b: (sent.append(queries.count()), plain(queries, items, *a, **b))[1])
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(600, 12))
    rows[:200] = rows[0] + rng.normal(size=(200, 12)) * 1e-3  # one hot cell
    rows[7] = 0.0
    data = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, features array<double>")
    want = sorted(map(tuple, similarity.nearest(data, data, 6).collect()))
    assert sorted(map(tuple, similarity.nearest(data, data, 6, few=0).collect())) == want
    # at most the pieces that the tasks ask for, whatever the number of cells; to 64 cells it was over 20,000 rows
    assert sent[-1] <= 600 * 12
