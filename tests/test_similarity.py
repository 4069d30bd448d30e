import datetime as dt

import numpy as np
import pytest

from vibralake.operators import scaling, similarity


def brute(events, history, k):
    h = np.array([v for _, v in history], dtype=float)
    mean, std = h.mean(axis=0), h.std(axis=0)
    std[std == 0] = 1.0

    def unit(rows):
        rows = (np.array(rows, dtype=float) - mean) / std
        n = np.linalg.norm(rows, axis=1, keepdims=True)
        return np.divide(rows, n, out=np.zeros_like(rows), where=n > 0)

    scores = np.round(unit([v for _, v in events]) @ unit([v for _, v in history]).T, 9)
    out = {}
    for (q, _), line in zip(events, scores):
        out[q] = sorted(((-s, i) for s, (i, _) in zip(line, history)))[:k]
    return {q: [(i, -s) for s, i in rows] for q, rows in out.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, features array<double>")


def found(df):
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["item_id"], r["score"]))
    return out


def make(n, seed, copies=0, zeros=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, 5)) * 4
    rows = [centers[i % 6] + rng.normal(size=5) for i in range(n)]
    rows += [np.array([1.0, 2.0, 3.0, 4.0, 5.0])] * copies
    return [(i, list(np.round(r, 3))) for i, r in enumerate(rows)]


@pytest.mark.parametrize("few", [10_000, 0])
def test_equals_brute_force(spark, few, monkeypatch):
    # Small pieces and few pivots, so that the grid has many of both.
    monkeypatch.setattr(similarity, "PIVOTS", 8)
    monkeypatch.setattr(similarity.topk, "ITEMS_PER_PIECE", 40)
    monkeypatch.setattr(similarity.topk, "QUERIES_PER_PIECE", 16)
    # A third of the history is one vector.
    history = make(200, 1, copies=100)
    events = make(50, 2) + [(500, history[-1][1])]
    want = brute(events, history, 7)
    got = found(similarity.nearest(frame(spark, events), frame(spark, history), 7, few=few))
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-9)


@pytest.mark.parametrize("few", [10_000, 0])
def test_zero_vectors_score_zero(spark, few):
    history = [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 0.0]), (5, [0.5, 0.5])]
    scale = scaling.Scale([0.0, 0.0], [1.0, 1.0])
    events = [(10, [1.0, 0.0]), (11, [0.0, 0.0])]
    got = found(similarity.nearest(frame(spark, events), frame(spark, history), 4, scale=scale, few=few))
    assert [i for i, _ in got[10]] == [1, 5, 3, 4]
    assert got[11] == [(1, 0.0), (2, 0.0), (3, 0.0), (4, 0.0)]


def test_short_history_is_an_error(spark):
    rows = frame(spark, [(1, [1.0, 2.0])])
    with pytest.raises(ValueError):
        similarity.nearest(rows, rows, 2)


@pytest.fixture(scope="module")
def history(spark):
    day = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(12):
        category = "polia" if i < 8 else "correia"
        rows.append((i, day + dt.timedelta(days=i % 4), f"{category}_{i % 2}", category, 1000.0 + i, 25.0, 1.5, 2.0,
                     [float(i < 8) + 0.01 * i, float(i >= 8), 1.0]))
    return spark.createDataFrame(
        rows,
        "id long, created_at timestamp, fault string, fault_category string, rpm double, temperature_c double, "
        "z_rms_velocity_mm_s double, x_rms_velocity_mm_s double, features array<double>",
    )


def test_whole_answer(spark, history):
    events = history.filter("id in (2, 9)").select("id", "features")
    rows = {r["query_id"]: r for r in similarity.similar_events(events, history, 4).collect()}
    two = rows[2]
    assert two["similar_count"] == 4 and len(two["top_matches"]) == 4
    assert two["top_matches"][0]["id"] == 2 and two["top_matches"][0]["similarity_score"] == 100.0
    assert two["match_category"] == "polia" and two["total_historical_occurrences"] == 8
    assert two["events_per_active_day"] == 2.0 and len(two["time_distribution"]) == 4
    assert rows[9]["match_category"] == "correia" and rows[9]["total_historical_occurrences"] == 4
    assert all(0.0 <= m["similarity_score"] <= 100.0 for m in two["top_matches"])


def test_label_mode_takes_the_smallest(spark, history):
    neighbours = history.selectExpr("1L as query_id", "id as item_id", "cast(id as int) as rank", "*").filter("id < 4")
    row = similarity.operational_context(neighbours).first()
    assert row["primary_historical_fault"] == "polia_0"
    assert row["avg_rpm"] == 1001.5 and row["min_rpm"] == 1000.0 and row["max_rpm"] == 1003.0


def test_few_queries_do_not_shuffle_the_history(spark, history):
    rows = history.select("id", "features")
    plan = similarity.nearest(rows, rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "WindowGroupLimit" in plan
