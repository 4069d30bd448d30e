"""Cleaning and feature columns of sensor readings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vibralake import domain
from vibralake.functions import numeric


def clean_sensors(df: DataFrame, columns: Sequence[str] = domain.SENSORS, strict: bool = False) -> DataFrame:
    """Every sensor column as a double without null or NaN.

    Absent columns become 0.0. With ``strict`` they are left out, as in the
    batch path, where a missing feature input is an error later on.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cleaned: dict[str, Column] = {}
    for name in columns:
        if name not in types:
            if not strict:
                cleaned[name] = F.lit(0.0)
        elif isinstance(types[name], T.StringType):
            cleaned[name] = numeric.number_or_zero(F.col(name))
        else:
            cleaned[name] = numeric.double_or_zero(F.col(name))
    return df.withColumns(cleaned)


def add_features(
    df: DataFrame,
    ratios: Mapping[str, tuple[str, str]] = domain.AXIS_RATIOS,
    epsilon: float = domain.RATIO_EPSILON,
) -> DataFrame:
    """Six z/x ratios and three vibration energies."""
    c = F.col
    out = df.withColumns(
        {name: numeric.ratio(c(z), c(x) + F.lit(epsilon)) for name, (z, x) in ratios.items()}
    )
    energy = {
        f"vibration_energy_{axis}": c(f"{axis}_rms_velocity_mm_s") * c(f"{axis}_rms_velocity_mm_s")
        + c(f"{axis}_rms_acceleration_g") * c(f"{axis}_rms_acceleration_g")
        for axis in ("z", "x")
    }
    return out.withColumns(energy).withColumn(
        "total_vibration_energy", c("vibration_energy_z") + c("vibration_energy_x")
    )


def feature_array(columns: Sequence[str] = domain.FEATURES) -> Column:
    """The ordered feature row as one array, infinities and NaN set to 0.0."""
    return F.array(*[numeric.finite_or_zero(F.col(c)) for c in columns])


def select_features(df: DataFrame, *keep: str, columns: Sequence[str] = domain.FEATURES) -> DataFrame:
    return df.select(*keep, *columns)


def stored_projection(df: DataFrame) -> DataFrame:
    """Columns of the readings table: text timestamp, 0/1 flag, those that exist."""
    have = [c for c in domain.STORED_COLUMNS if c in df.columns]
    pattern = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    if isinstance(df.schema["created_at"].dataType, T.TimestampType):
        pattern += "xxx"
    return df.select(*have).withColumns(
        {
            "created_at": F.date_format("created_at", pattern),
            "is_problem": F.col("is_problem").cast("int"),
        }
    )


def time_sorted(df: DataFrame, time: str = "created_at", key: str = "id") -> DataFrame:
    """Rows by time, missing times last; the key settles equal times."""
    return df.orderBy(F.col(time).asc_nulls_last(), F.col(key))
