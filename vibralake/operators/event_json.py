"""Sensor events that arrive as JSON text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vibralake import domain
from vibralake.functions import numeric
from vibralake.session import computed_once

# Fields kept as they are; everything else known is numeric.
TEXT_FIELDS = ("id", "created_at", "fault")


def parse(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``fields`` (name -> text) and ``keys``; both null for broken JSON.

    A map of texts keeps quoted and bare numbers alike, and null-valued keys
    stay visible in ``keys``. The object has to be the whole text: it is read as
    the only element of an array, which anything after it breaks. Of a
    repeated key the last value counts.
    """
    listed = F.from_json(F.concat(F.lit("["), F.col(payload), F.lit("]")), "array<map<string,string>>")
    parsed = computed_once(df, _listed=listed, keys=F.array_distinct(F.json_object_keys(F.col(payload))))
    first = F.when(F.size("_listed") == 1, F.col("_listed")[0])
    names = F.array_distinct(F.map_keys(first))
    last = F.transform(names, lambda k: F.element_at(F.filter(F.map_entries(first), lambda e: e["key"] == k), -1)["value"])
    fields = F.when(F.size(F.map_keys(first)) == F.size(names), first).otherwise(F.map_from_arrays(names, last))
    whole = F.col("_listed")[0].isNotNull() & (F.size("_listed") == 1)
    return computed_once(parsed, fields=F.when(whole, fields)).drop("_listed")


def field(name: str) -> Column:
    return F.col("fields")[name]


def _truth(name: str, payload: str) -> Column:
    """Whether a field is a bare ``true`` or ``false``, which count as 1 and 0."""
    bare = F.col(payload).rlike(f'"{name}"\\s*:\\s*(true|false)\\s*[,}}]')
    return F.coalesce(field(name).isin("true", "false") & bare, F.lit(False))


def _is_number(name: str, payload: str) -> Column:
    return F.coalesce(field(name).rlike(numeric.NUMBER_OR_NAN), F.lit(False)) | _truth(name, payload)


def errors(
    required: Sequence[str] = domain.REQUIRED_FIELDS,
    optional: Sequence[str] = tuple(domain.PAYLOAD_DEFAULTS),
    payload: str = "payload",
) -> Column:
    """Names of what is wrong with a parsed event; empty when it is valid.

    A required field must be there and be a number or a bare truth value. An optional one may be
    absent or null, but text that is no number is refused. The id is a whole number, also written as ``5.0``.
    """
    checks = [F.when(~_is_number(c, payload), F.lit(c)) for c in required]
    checks += [F.when(field(c).isNotNull() & ~_is_number(c, payload), F.lit(c)) for c in optional]
    whole = F.coalesce(field("id").rlike(r"^[+-]?[0-9]+(\.0+)?$"), F.lit(True)) | _truth("id", payload)
    checks.append(F.when(~whole, F.lit("id")))
    found = F.filter(F.array(*checks), lambda e: e.isNotNull())
    return F.when(F.col("fields").isNull(), F.array(F.lit("json"))).otherwise(found)


def validate(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Parsed events with ``errors`` and ``is_valid``."""
    checked = computed_once(parse(df, payload), errors=errors(payload=payload))
    return checked.withColumn("is_valid", F.size("errors") == 0)


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter("is_valid")


def quarantine(validated: DataFrame, payload: str = "payload") -> DataFrame:
    return validated.filter("not is_valid").select(payload, "errors")


def sensor_columns(
    df: DataFrame, defaults: str = "api", constants: Mapping[str, float] = domain.PAYLOAD_DEFAULTS
) -> DataFrame:
    """Typed event columns from parsed ``fields``.

    ``defaults="api"`` puts the service constants where an optional field is
    absent; ``"zero"`` puts 0.0. A field that is present but null is 0.0 in
    both, which is why absence is read from ``keys``.
    """
    if defaults not in ("api", "zero"):
        raise ValueError("defaults is 'api' or 'zero'")
    columns = {}
    for name in domain.SENSORS:
        value = F.when(field(name) == "true", 1.0).otherwise(numeric.number_or_zero(field(name)))
        if defaults == "api" and name in constants:
            absent = ~F.array_contains("keys", name)
            value = F.when(absent, F.lit(constants[name])).otherwise(value)
        columns[name] = value
    typed = {
        "id": F.when(field("id") == "true", 1).when(field("id") == "false", 0).otherwise(
            F.regexp_replace(field("id"), r"\.0+$", "").try_cast("long")
        ),
        "created_at": F.try_to_timestamp(field("created_at")),
        "fault": field("fault"),
    }
    return df.withColumns({**typed, **columns}).drop("fields", "keys", "errors", "is_valid")


def to_json(*columns: str) -> Column:
    """Event columns back to JSON text, null fields included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
