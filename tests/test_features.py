import math

import pytest

from vibralake import domain
from vibralake.functions import numeric
from vibralake.operators import features, scaling
from pyspark.sql import functions as F

SAMPLE = {
    "z_rms_velocity_mm_s": 4.5, "x_rms_velocity_mm_s": 1.5, "z_peak_acceleration_g": 0.9, "x_peak_acceleration_g": 0.6,
    "z_rms_acceleration_g": 0.3, "x_rms_acceleration_g": 0.2, "z_kurtosis": 2.8, "x_kurtosis": 3.5,
    "z_crest_factor": 5.0, "x_crest_factor": 2.5, "z_high_freq_rms_accel_g": 0.7, "x_high_freq_rms_accel_g": 0.35,
}


def test_engineered_values(spark):
    row = features.add_features(spark.createDataFrame([SAMPLE])).first()
    assert row["kurtosis_ratio_zx"] == pytest.approx(0.8, abs=1e-4)
    for axis in "zx":
        energy = SAMPLE[f"{axis}_rms_velocity_mm_s"] ** 2 + SAMPLE[f"{axis}_rms_acceleration_g"] ** 2
        assert row[f"vibration_energy_{axis}"] == pytest.approx(energy)
    assert row["total_vibration_energy"] == pytest.approx(row["vibration_energy_z"] + row["vibration_energy_x"])


def test_zero_denominator(spark):
    rows = spark.createDataFrame([{**SAMPLE, "x_kurtosis": -1e-6}])
    assert features.add_features(rows).first()["kurtosis_ratio_zx"] == 0.0


def test_event_features_have_model_order(spark):
    event = spark.createDataFrame([{**SAMPLE, "rpm": 1000.0, "temperature_c": 25.0}])
    found = features.select_features(features.add_features(features.clean_sensors(event)))
    assert found.columns == list(domain.FEATURES)
    assert len(found.columns) == 32 and found.count() == 1
    assert found.first()["temperature_f"] == 0.0


def test_strict_leaves_missing_columns_out(spark):
    event = spark.createDataFrame([{"rpm": "12"}])
    assert features.clean_sensors(event, strict=True).columns == ["rpm"]


@pytest.mark.parametrize(
    "text,value",
    [("abc", 0.0), ("", 0.0), (None, 0.0), ("NaN", 0.0), ("inf", math.inf), ("-Infinity", -math.inf), ("1.5d", 0.0),
     ("1.5f", 0.0), ("0x10", 0.0), (" 1.5 ", 1.5), ("-2.5e1", -25.0), (".5", 0.5), ("5.", 5.0)],
)
def test_number_or_zero(spark, text, value):
    row = spark.createDataFrame([(text,)], "s string").select(numeric.number_or_zero(F.col("s")).alias("v")).first()
    assert row["v"] == value


def test_finite_or_zero(spark):
    rows = spark.createDataFrame([(math.inf,), (-math.inf,), (math.nan,), (None,), (2.0,)], "v double")
    assert [r[0] for r in rows.select(numeric.finite_or_zero(F.col("v"))).collect()] == [0, 0, 0, 0, 2]


def test_scaling(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    stats = {r["feature"]: r for r in scaling.column_stats(rows, ["a", "b"]).collect()}
    assert stats["a"]["std"] == pytest.approx(math.sqrt(2 / 3))
    assert stats["b"]["scale"] == 1.0
    scaled = scaling.standardise(rows, ["a", "b"], scaling.fit_columns(rows, ["a", "b"])).orderBy("a").collect()
    assert [r["b"] for r in scaled] == [0.0, 0.0, 0.0]
    assert scaled[0]["a"] == pytest.approx(-1.2247448714)
    arrays = rows.select(F.array("a", "b").alias("v"))
    fitted = scaling.fit_array(arrays, "v")
    assert fitted.mean == pytest.approx([2.0, 5.0]) and fitted.scale == pytest.approx([math.sqrt(2 / 3), 1.0])


def test_time_sort_puts_missing_last(spark):
    rows = spark.createDataFrame([(1, None), (2, "2024-01-02"), (3, "2024-01-01")], "id long, created_at string")
    assert [r["id"] for r in features.time_sorted(rows).collect()] == [3, 2, 1]
