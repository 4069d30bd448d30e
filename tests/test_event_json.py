import json

import pytest

from vibralake import domain
from vibralake.operators import event_json

FULL = {c: 1.0 + i for i, c in enumerate(domain.REQUIRED_FIELDS)}


def rows(spark, *payloads):
    return spark.createDataFrame([(p if isinstance(p, str) else json.dumps(p),) for p in payloads], "payload string")


def test_accepts_partial_payload_with_defaults(spark):
    checked = event_json.accepted(event_json.validate(rows(spark, {**FULL, "id": 7, "extra": 1})))
    row = event_json.sensor_columns(checked).first()
    assert row["id"] == 7 and row["rpm"] == 1.0
    assert {c: row[c] for c in domain.PAYLOAD_DEFAULTS} == domain.PAYLOAD_DEFAULTS
    zero = event_json.sensor_columns(checked, "zero").first()
    assert all(zero[c] == 0.0 for c in domain.PAYLOAD_DEFAULTS)


def test_explicit_null_is_not_absent(spark):
    checked = event_json.accepted(event_json.validate(rows(spark, {**FULL, "temperature_f": None})))
    assert event_json.sensor_columns(checked).first()["temperature_f"] == 0.0


def test_quoted_numbers_are_numbers(spark):
    checked = event_json.accepted(event_json.validate(rows(spark, {**FULL, "rpm": "1000.5"})))
    assert event_json.sensor_columns(checked).first()["rpm"] == 1000.5


@pytest.mark.parametrize(
    "payload,errors",
    [
        ("{bad", ["json"]),
        ({k: v for k, v in FULL.items() if k != "rpm"}, ["rpm"]),
        ({**FULL, "x_kurtosis": "abc"}, ["x_kurtosis"]),
        ({**FULL, "x_kurtosis": None}, ["x_kurtosis"]),
        ({**FULL, "temperature_f": "warm"}, ["temperature_f"]),
        ({**FULL, "id": "x1"}, ["id"]),
    ],
)
def test_refuses(spark, payload, errors):
    refused = event_json.quarantine(event_json.validate(rows(spark, payload, FULL))).collect()
    assert [r["errors"] for r in refused] == [errors]


def test_json_is_parsed_once(spark):
    checked = event_json.accepted(event_json.validate(rows(spark, FULL)))
    plan = event_json.sensor_columns(checked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_to_json_keeps_nulls(spark):
    row = spark.createDataFrame([(1, None)], "a int, b string").select(event_json.to_json("a", "b").alias("j")).first()
    assert json.loads(row["j"]) == {"a": 1, "b": None}
