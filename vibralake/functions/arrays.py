"""Expressions over class probabilities held in arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def confidence(probabilities: Column) -> Column:
    """Largest probability as a percentage, unrounded."""
    return F.array_max(probabilities) * 100.0


def predicted(labels: Column, probabilities: Column) -> Column:
    return F.element_at(labels, argmax(probabilities) + 1)


def percentages(probabilities: Column, digits: int = 2) -> Column:
    return F.transform(probabilities, lambda p: F.round(p * 100.0, digits))


def probability_map(labels: Column, probabilities: Column) -> Column:
    return F.map_from_arrays(labels, percentages(probabilities))


def top_probabilities(labels: Column, probabilities: Column, n: int) -> Column:
    """First ``n`` of ``(probability, label)`` by falling rounded percentage.

    Equal percentages keep the label order of the input, so the position is
    part of the sort key.
    """
    shown = percentages(probabilities)
    entries = F.transform(
        F.arrays_zip(shown.alias("p"), labels.alias("l")),
        lambda e, i: F.struct((-e["p"]).alias("key"), i.alias("position"), e["l"].alias("label"), e["p"].alias("probability")),
    )
    best = F.slice(F.array_sort(entries), 1, n)
    return F.transform(best, lambda e: F.struct(e["label"].alias("label"), e["probability"].alias("probability")))
