"""A stored index of the history, searched without reading what cannot hold a neighbour.

The scaled rows, of unit length, lie in files by cell: that of the nearest of some pivot rows. Beside them are the pivots, and each cell's size and
widest angle to its pivot. A search first reads the cells around its events, enough of them to have k rows; the k-th angle so far then
rules out, by the triangle inequality, every cell that begins beyond it. What is read is named by a filter on the partition column, so
Spark opens the files of these cells only.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vibralake import domain
from vibralake.operators import scaling, similarity, topk
from vibralake.session import durable, fits

# The cell of rows that have no direction.
NO_DIRECTION = -1


class Index(NamedTuple):
    """``vectors`` (key, features, cell) in files by cell; per cell its pivot, size and radius."""

    vectors: DataFrame
    cells: np.ndarray
    pivots: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    scale: scaling.Scale
    key: str


def usable(features: str):
    return F.col(features).isNotNull() & ~F.exists(features, lambda x: x.isNull())


def build(history: DataFrame, path: str, features: str = "features", key: str = "id", pivots: int | None = None) -> Index:
    """Write the index of all rows that have a whole vector; the scale is fitted on them."""
    items = history.filter(usable(features)).select(F.col(key), F.col(features).cast("array<double>").alias("features"))
    scale = scaling.fit_array(items, "features")
    wanted = pivots or min(similarity.MOST_PIVOTS, max(similarity.PIVOTS, math.isqrt(items.count())))
    chosen = items.orderBy(F.xxhash64(key), key).limit(wanted).toArrow()
    held = similarity.unit_rows(topk.matrix(chosen["features"]), scale)
    held = held[np.linalg.norm(held, axis=1) > 0]

    def place(batches):
        for batch in similarity._blocks(batches, len(held)):
            rows = similarity.unit_rows(topk.matrix(batch.column("features")), scale)
            cell, reach = np.full(len(rows), NO_DIRECTION, np.int32), np.zeros(len(rows))
            there = np.flatnonzero(np.linalg.norm(rows, axis=1) > 0)
            if len(there):
                angle = similarity._angles(rows[there], held)
                cell[there] = angle.argmin(axis=1)
                reach[there] = angle.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(key), similarity._lists(rows), pa.array(cell), pa.array(reach)], [key, "features", "cell", "reach"])

    kind = items.schema[key].dataType.simpleString()
    placed = durable(items.mapInArrow(place, f"`{key}` {kind}, features array<double>, cell int, reach double"))
    placed.drop("reach").hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    rows = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("reach")).collect()  # one per pivot at most
    settings = {
        "mean": list(scale.mean), "scale": list(scale.scale), "key": key,
        "cells": [[r["cell"], r["n"], r["reach"], held[r["cell"]].tolist() if r["cell"] >= 0 else []] for r in sorted(rows, key=lambda r: r["cell"])],
    }
    history.sparkSession.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")
    return load(history.sparkSession, path)


def load(spark: SparkSession, path: str) -> Index:
    settings = json.loads(spark.read.text(f"{path}/settings").first()["value"])
    cells, width = settings["cells"], len(settings["mean"])
    pivots = np.array([c[3] or [0.0] * width for c in cells], float).reshape(len(cells), width)
    numbers = [np.array([c[i] for c in cells], t) for i, t in ((0, np.int64), (1, np.int64), (2, float))]
    vectors = spark.read.parquet(f"{path}/vectors")
    return Index(vectors, numbers[0], pivots, numbers[1], numbers[2], scaling.Scale(settings["mean"], settings["scale"]), settings["key"])


def rows_of(index: Index, cells: np.ndarray) -> DataFrame:
    """The vectors of some cells; no other file is opened."""
    return index.vectors.filter(F.col("cell").isin(cells.tolist())).drop("cell")


def angles(index: Index, rows: np.ndarray) -> np.ndarray:
    """Angle of each query to each cell's pivot; cells without direction are a quarter turn away."""
    out = similarity._angles(rows, index.pivots)
    out[:, index.cells == NO_DIRECTION] = np.pi / 2
    return out


def around(index: Index, angle: np.ndarray, k: int) -> np.ndarray:
    """Whether some query needs the cell to have k rows, taking the nearest cells first."""
    near = np.argsort(angle, axis=1, kind="stable")
    before = np.cumsum(index.sizes[near], axis=1) - index.sizes[near]
    wanted = np.zeros(angle.shape, bool)
    np.put_along_axis(wanted, near, before < k, axis=1)
    return wanted.any(axis=0)


def search(events: DataFrame, index: Index, k: int = domain.SIMILAR_TOP_K, features: str = "features", key: str = "id", few: int = topk.FEW_QUERIES) -> DataFrame:
    """``(query_id, item_id, score, rank)``: the k nearest rows of each event, as ``similarity.nearest`` gives them.

    Up to ``few`` events are held by the driver, to name the cells; more meet all vectors in the grid of ``similarity.nearest``.
    """
    if int(index.sizes.sum()) < k:
        raise ValueError(f"history holds fewer than k={k} rows")
    queries = events.filter(usable(features)).select(F.col(key).alias("query_id"), F.col(features).cast("array<double>").alias("features"))

    scale = index.scale

    def turned(batches):
        for batch in batches:
            rows = similarity.unit_rows(topk.matrix(batch.column("features")), scale)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), similarity._lists(rows)], ["query_id", "features"])

    unit = durable(queries.mapInArrow(turned, queries.schema))
    if not fits(unit, few):
        plain = scaling.Scale([0.0] * len(index.scale.mean), [1.0] * len(index.scale.mean))
        return similarity.nearest(unit.withColumnRenamed("query_id", index.key), index.vectors.drop("cell"), k, plain, key=index.key, few=few)
    held = unit.toArrow()
    rows = topk.matrix(held["features"]) if held.num_rows else np.zeros((0, len(index.scale.mean)))
    angle = angles(index, rows)
    # a query without direction scores 0 everywhere: the lowest ids are its neighbours, wherever they lie
    lost = np.linalg.norm(rows, axis=1) == 0
    first = around(index, angle[~lost], k) if not lost.all() else np.zeros(len(index.cells), bool)
    scorer = similarity._unit_scorer("features")
    found = durable(topk.rank(topk.scan(unit, rows_of(index, index.cells[first]), k, scorer, "query_id", index.key), k))
    worst = {r["query_id"]: r["s"] for r in found.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).filter(F.col("n") >= k).collect()}
    score = np.array([worst.get(q, -1.0) for q in held["query_id"].to_pylist()], float)
    bound = np.arccos(np.clip(score - similarity.SLACK, -1.0, 1.0))
    second = ((angle - index.radii <= bound[:, None] + similarity.SLACK) & ~lost[:, None]).any(axis=0) & ~first
    parts = [found.drop("rank")]
    if second.any():
        parts.append(topk.scan(unit, rows_of(index, index.cells[second]), k, scorer, "query_id", index.key))
    if lost.any():
        lowest = index.vectors.orderBy(index.key).limit(k).drop("cell")
        parts.append(topk.scan(unit.filter(F.forall("features", lambda x: x == 0)), lowest, k, scorer, "query_id", index.key))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return topk.rank(every.dropDuplicates(["query_id", "item_id"]), k)
