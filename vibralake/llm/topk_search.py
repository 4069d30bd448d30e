"""Exact top-k by inner product with the threshold algorithm over sorted lists.

The vectors are dealt into shards. A shard keeps, for every dimension, the list of its
rows sorted by that component. A query reads all lists in step, from the top where its
component is positive and from the bottom where it is negative; rows that come up are scored in
full. After each step no unread row can score more than the sum over dimensions of
the query's component times the list's value at the present depth. Once this bound is below
the k-th best score, the shard is done; a bound equal to it is not enough, as a tie
goes to the smaller id. Where the lists of a shard have shown half of its rows the
others are scored too, which is what reading on would come to.

A shard scores a block of queries at a time and every depth is one vectorised step. It keeps the best k
rows of each query, so shards x queries x k rows are merged by a window at the
end, pruned to k before its shuffle. Query blocks meet shards by an equi-join on the
block's bucket; neither side is held whole anywhere: a shard has ``SHARD`` rows, a block ``QUERIES``.

Components are turned into floor(scale * x). Scores are exact integers: products are made in
doubles where every partial sum stays below 2**53, and in 64-bit integers else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vibralake.session import written

SHARD = 8192
QUERIES = 512
SCALE = 64
FIRST_DEPTH = 4


def usable(vector: str) -> Column:
    """Whether an array holds numbers only: no nulls, NaN or infinities, and at least one."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def blocks(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, v array<long>) as blocks (width, bucket, ids, matrix) of at most ``size`` rows; buckets (_w, _b) per width.

    Vectors of different widths never share a block. Rows are dealt into hash buckets of somewhat fewer rows than
    a block holds; a bucket that has more, by chance or repeated ids, is cut into several blocks.
    """
    counts = written(rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")), "widths")
    buckets = counts.select(F.col("width").alias("_w"), F.ceil(F.col("n") / (0.85 * size)).cast("long").alias("_b"))
    placed = rows.join(buckets, F.size("v") == F.col("_w"))
    dealt = placed.withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("_b")))
    number = F.row_number().over(Window.partitionBy("_w", "bucket").orderBy("id"))
    cut = dealt.withColumn("part", F.floor((number - 1) / size))

    def packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        matrix = np.stack(frame["v"].to_numpy()).astype(np.int64)
        order = np.argsort(frame["id"].to_numpy(), kind="stable")
        ids = frame["id"].to_numpy(np.int64)[order]
        return pd.DataFrame({"width": [key[0]], "bucket": [key[1]], "ids": [ids.tobytes()], "matrix": [matrix[order].tobytes()]})

    made = cut.groupBy("_w", "bucket", "part").applyInPandas(packed, "width int, bucket long, ids binary, matrix binary")
    return written(made, "blocks"), buckets


def exact_products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, in doubles where these are exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if most < 2.0**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


class Shard:
    """Rows with their sorted per-dimension lists."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.lists = np.argsort(matrix, axis=0, kind="stable")  # ascending, one list per column
        self.values = np.take_along_axis(matrix, self.lists, axis=0)

    def bound(self, queries: np.ndarray, depth: int) -> np.ndarray:
        """The most that a row not among the first ``depth`` of any list can score."""
        n = len(self.ids)
        if depth >= n:
            return np.full(len(queries), -np.inf)
        high, low = self.values[n - 1 - depth].astype(float), self.values[depth].astype(float)
        return np.maximum(queries, 0) @ high + np.minimum(queries, 0) @ low

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query place, id and score of the best ``k`` rows of each query, its own row left out."""
        n, d = self.matrix.shape
        places, found, scores = [], [], []

        def take(place: int, rows: np.ndarray, score: np.ndarray) -> None:
            other = self.ids[rows] != query_ids[place]
            rows, score = rows[other], score[other]
            if len(rows) > k:
                edge = np.partition(score, len(score) - k)[len(score) - k]
                rows, score = rows[score >= edge], score[score >= edge]
            order = np.lexsort((self.ids[rows], -score))[:k]
            places.append(np.full(len(order), place))
            found.append(self.ids[rows[order]])
            scores.append(score[order])

        open_ = np.arange(len(queries))
        seen = np.zeros((len(queries), n), bool)
        depth = 0
        while len(open_):
            deeper = min(n, max(FIRST_DEPTH, 4 * depth))
            top, bottom = self.lists[n - deeper : n - depth], self.lists[depth:deeper]
            still = []
            for q in open_.tolist():
                up = queries[q] >= 0
                seen[q, top[:, up].ravel()] = True
                seen[q, bottom[:, ~up].ravel()] = True
            bounds = self.bound(queries[open_].astype(float), deeper)
            for q, bound in zip(open_.tolist(), bounds.tolist(), strict=True):
                read = np.flatnonzero(seen[q])
                if 2 * len(read) >= n or deeper >= n:
                    continue
                score = exact_products(queries[q : q + 1], self.matrix[read])[0]
                count = int((self.ids[read] != query_ids[q]).sum())
                mine = np.sort(score[self.ids[read] != query_ids[q]])
                if count >= k and bound < mine[count - k]:
                    take(q, read, score)
                else:
                    still.append(q)
            rest = np.array([q for q in open_.tolist() if 2 * seen[q].sum() >= n or deeper >= n], np.int64)
            if len(rest):  # the lists have shown most rows of the shard
                product = exact_products(queries[rest], self.matrix)
                for q, score in zip(rest.tolist(), product, strict=True):
                    take(q, np.arange(n), score)
            open_, depth = np.array(still, np.int64), deeper
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(found), np.concatenate(scores)


def search(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Best ``k`` rows for each query: query_id, rank (from 1), id, score.

    Both frames have columns id (long) and v (array of integers). A query's own id is no candidate;
    fewer candidates give fewer rows; ties go to the smaller id. Rows that repeat an id are candidates of their own,
    and a repeated query gets its answer once. Vectors of another width than the
    query's are no candidates. Null ids take no part.
    """
    queries = queries.filter("id is not null").dropDuplicates(["id"])
    shards, _ = blocks(rows.filter("id is not null"), SHARD)
    asked, held = blocks(queries, QUERIES)
    wide = shards.join(held, F.col("width") == F.col("_w")).select("width", F.col("ids").alias("row_ids"), F.col("matrix").alias("row_matrix"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)).alias("bucket"))
    grid = wide.join(asked, ["width", "bucket"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, shard = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if mark != (cell["width"], cell["row_ids"]):
                    mark = (cell["width"], cell["row_ids"])
                    shard = Shard(np.frombuffer(cell["row_ids"], np.int64), np.frombuffer(cell["row_matrix"], np.int64).reshape(-1, cell["width"]))
                ids = np.frombuffer(cell["ids"], np.int64)
                matrix = np.frombuffer(cell["matrix"], np.int64).reshape(-1, cell["width"])
                place, found, score = shard.best(ids, matrix, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[place]), pa.array(found), pa.array(score)], ["query_id", "id", "score"])

    cells = grid.select("width", "row_ids", "row_matrix", "ids", "matrix").mapInArrow(answer, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    best = cells.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def integer_vectors(table: DataFrame, id_: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v) with v = floor(scale * x), of the rows whose vector holds numbers only."""
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return table.filter(usable(vector)).select(F.col(id_).cast("long").alias("id"), v.alias("v"))
