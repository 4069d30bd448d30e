import datetime as dt

import pytest
from pyspark.sql import functions as F

from vibralake.operators import dashboard

DAY = dt.datetime(2024, 1, 1, 10)


@pytest.fixture(scope="module")
def readings(spark):
    rows = [
        (1, DAY, "normal", False),
        (2, DAY, "polia", True),
        (3, DAY + dt.timedelta(hours=5), "polia", True),
        (4, DAY + dt.timedelta(days=1), "polia", True),
        (5, DAY, "correia", True),
    ]
    return spark.createDataFrame(rows, "id long, created_at timestamp, fault_category string, is_problem boolean")


def test_kpis(spark, readings):
    docs = spark.range(3)
    row = dashboard.kpis(readings, docs, spark.range(0)).first()
    assert (row.total_events, row.total_problems, row.total_docs, row.total_prescriptions) == (5, 4, 3, 0)
    assert row.normal_ratio == pytest.approx(20.0, abs=1e-3)


def test_kpis_of_nothing(spark, readings):
    row = dashboard.kpis(readings.limit(0), spark.range(0), spark.range(0)).first()
    assert row.total_events == 0 and row.normal_ratio == 100.0


def test_distribution(readings):
    found = [(r["fault_category"], r["count"], r["is_problem"]) for r in dashboard.category_distribution(readings).collect()]
    assert found == [("polia", 3, True), ("correia", 1, True), ("normal", 1, False)]
    ranked = dashboard.problem_ranking(dashboard.category_distribution(readings)).collect()
    assert [r["fault_category"] for r in ranked] == ["correia", "polia"]


def test_timeline(readings):
    found = [tuple(r) for r in dashboard.daily_timeline(readings).collect()]
    assert found == [
        (dt.date(2024, 1, 1), "correia", 1), (dt.date(2024, 1, 1), "polia", 2), (dt.date(2024, 1, 2), "polia", 1),
    ]


def test_recurrence_and_histogram(readings):
    daily = dashboard.daily_counts(readings)
    found = {r["fault_category"]: r for r in dashboard.recurrence(daily).collect()}
    assert found["polia"]["events_per_active_day"] == 1.5
    assert found["correia"]["events_per_active_day"] == 1.0
    assert found["polia"]["last_seen"] == DAY + dt.timedelta(days=1)
    days = dashboard.date_histogram(daily).select("fault_category", F.map_entries("time_distribution").alias("e"))
    maps = {r["fault_category"]: [tuple(e) for e in r["e"]] for r in days.collect()}
    assert maps["polia"] == [(dt.date(2024, 1, 1), 2), (dt.date(2024, 1, 2), 1)]


def test_counts_combine_before_the_shuffle(readings):
    plan = dashboard.value_counts(readings)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
