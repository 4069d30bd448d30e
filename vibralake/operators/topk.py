"""Exact k best items per query by score.

Two ways to the same rows. Few queries travel to the items: the items are read
once where they lie, each task keeps k rows per query, and only those are
shuffled. Many queries meet the items in a grid of bounded pieces, so neither
side has to fit in one task. A pair of a query and an item exists only as a
number inside a task; what leaves a task is at most k rows per query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vibralake.session import small_side

# Queries up to this many are sent to the items.
FEW_QUERIES = 4_096
# Upper bounds of one grid piece.
QUERIES_PER_PIECE = 4_096
ITEMS_PER_PIECE = 65_536
# Scores held at once inside a task.
BLOCK_SCORES = 4_000_000
SCORE_DIGITS = 9

RESULT = "query_id {q}, item_id {i}, score double"


def block_rows(queries: int, entries: int = 1) -> int:
    """Rows per block, for scorers that hold ``entries`` numbers per pair."""
    return max(64, BLOCK_SCORES // max(queries * entries, 1))


class Best:
    """The k best (score, id) per query seen so far; equal scores go to the lower id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.bar = np.full(queries, -np.inf)
        self.query = np.empty(0, dtype=np.int64)
        self.score = np.empty(0)
        self.item: np.ndarray | None = None

    def offer(self, items: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` is items by queries; -inf marks pairs that do not count."""
        if len(items) == 0:
            return
        bar = self.bar
        if len(items) > self.k:
            own = np.partition(scores, len(items) - self.k, axis=0)[len(items) - self.k]
            bar = np.maximum(bar, own)
        rows, cols = np.nonzero((scores >= bar) & (scores > -np.inf))
        self._merge(items, rows, cols, scores[rows, cols])

    def offer_to(self, asked: np.ndarray, items: np.ndarray, scores: np.ndarray) -> None:
        """The same for the queries ``asked`` only, with scores that are not rounded yet: few reach the bar, and only they are rounded."""
        bar = self.bar[asked]
        if len(items) > self.k and np.isneginf(bar).any():
            bar = np.maximum(bar, np.partition(scores, len(items) - self.k, axis=0)[len(items) - self.k])
        rows, cols = np.nonzero(scores >= bar - 10.0**-SCORE_DIGITS)
        rounded, cols = np.round(scores[rows, cols], SCORE_DIGITS), asked[cols]
        kept = rounded >= self.bar[cols]
        if kept.any():
            self._merge(items, rows[kept], cols[kept], rounded[kept])

    def _merge(self, items: np.ndarray, rows: np.ndarray, cols: np.ndarray, scores: np.ndarray) -> None:
        query = np.concatenate([self.query, cols])
        score = np.concatenate([self.score, scores])
        item = items[rows] if self.item is None else np.concatenate([self.item, items[rows]])
        order = np.lexsort((item, -score, query))
        query, score, item = query[order], score[order], item[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.query, self.score, self.item = query[keep], score[keep], item[keep]
        full = place[keep] == self.k - 1
        self.bar[self.query[full]] = self.score[full]


def _array(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return values.astype(str) if values.dtype == object else values


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equally long number lists as a two-dimensional array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _frame(best: Best, query_ids: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    if best.item is None or len(best.query) == 0:
        return pa.RecordBatch.from_arrays([pa.array([], type=f.type) for f in schema], schema=schema)
    columns = [query_ids[best.query], best.item, best.score]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _result_types(queries: DataFrame, items: DataFrame, query_id: str, item_id: str) -> tuple[str, pa.Schema]:
    q, i = queries.schema[query_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    types = [to_arrow_type(df.schema[name].dataType) for df, name in ((queries, query_id), (items, item_id))]
    schema = pa.schema([("query_id", types[0]), ("item_id", types[1]), ("score", pa.float64())])
    return RESULT.format(q=q, i=i), schema


def rank(partial: DataFrame, k: int) -> DataFrame:
    """Final k per query from partial results, with ``rank`` from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def scan(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    scorer: Callable[[pa.Table], Callable[[pa.Table], np.ndarray]],
    query_id: str,
    item_id: str,
    entries: int = 1,
) -> DataFrame:
    """Few queries: one pass over the items, no shuffle of them.

    ``scorer(queries)`` prepares the query side once per task and returns a
    function from a block of items to scores, items by queries. The caller has
    checked that the queries are few.
    """
    ddl, schema = _result_types(queries, items, query_id, item_id)
    shared = queries.sparkSession.sparkContext.broadcast(queries.toArrow())

    def run(batches):
        held = shared.value
        score = scorer(held)
        best, step = Best(held.num_rows, k), block_rows(held.num_rows, entries)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for at in range(0, table.num_rows, step):
                block = table.slice(at, step)
                best.offer(_array(block[item_id]), np.round(score(block), SCORE_DIGITS))
        yield _frame(best, _array(held[query_id]), schema)

    return items.mapInArrow(run, ddl)


def grid(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    scorer: Callable[[pa.Table], Callable[[pa.Table], np.ndarray]],
    query_id: str,
    item_id: str,
    cell: str,
    pieces: DataFrame,
    entries: int = 1,
    meet: Callable[[pa.Table, pa.Table, pa.Schema], list[pa.RecordBatch]] | None = None,
) -> DataFrame:
    """Many queries: score each cell's queries against the cell's items.

    ``meet`` may do so in its own way; it returns batches of the result.

    Both sides carry ``cell``. ``pieces`` has one row per cell with
    ``item_pieces`` and ``query_pieces``, chosen from counts so that a piece is
    bounded; a hot cell simply gets more pieces. A task sees one query piece
    and one item piece.
    """
    ddl, schema = _result_types(queries, items, query_id, item_id)
    plan = small_side(pieces)

    def spread(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        return (
            df.join(plan, cell)
            .withColumn("_own", F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .drop(own, other)
        )

    left = spread(queries, query_id, "query_pieces", "item_pieces").withColumnsRenamed({"_own": "_qp", "_other": "_ip"})
    right = spread(items, item_id, "item_pieces", "query_pieces").withColumnsRenamed({"_own": "_ip", "_other": "_qp"})

    def run(held: pa.Table, found: pa.Table) -> pa.Table:
        if meet is not None:
            return pa.Table.from_batches(meet(held, found, schema), schema=schema)
        best, step = Best(held.num_rows, k), block_rows(held.num_rows, entries)
        if held.num_rows and found.num_rows:
            score = scorer(held)
            for at in range(0, found.num_rows, step):
                block = found.slice(at, step)
                best.offer(_array(block[item_id]), np.round(score(block), SCORE_DIGITS))
        return pa.Table.from_batches([_frame(best, _array(held[query_id]), schema)])

    keys = [cell, "_qp", "_ip"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, ddl)


def piece_plan(query_counts: DataFrame, item_counts: DataFrame, cell: str) -> DataFrame:
    """Pieces per cell from ``(cell, n)`` counts of both sides."""
    return query_counts.withColumnRenamed("n", "_q").join(item_counts.withColumnRenamed("n", "_i"), cell).select(
        cell,
        F.ceil(F.col("_q") / QUERIES_PER_PIECE).cast("int").alias("query_pieces"),
        F.ceil(F.col("_i") / ITEMS_PER_PIECE).cast("int").alias("item_pieces"),
    )
