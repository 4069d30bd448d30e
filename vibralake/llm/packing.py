"""Packing into length buckets whose bounds are optimal for the whole corpus.

Texts are cut into pieces of at most ``window`` tokens, so that no token is lost.
The global histogram of piece lengths, at most ``window`` rows, is all that reaches
the driver; dynamic programming over it finds the bounds of ``count`` buckets with
the fewest padding tokens. A piece is padded to the bound of its bucket, and a
bucket's batches hold as many pieces as the token budget allows.

Pieces of a bucket are numbered by length and id: a range-partitioned sort gives each
piece its place in its partition, and the partitions' sizes give the rest. Batches
are therefore full, save the last of each bucket, however many rows one
length or bucket holds, and the plan has no task that sees a whole bucket.

The tokens are words unless ``tokens`` names a column that holds counts of another
tokenizer. Texts without tokens make no piece. Rows that repeat an id are
pieces of their own; ties in length and id are interchangeable.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vibralake.llm.texts import word_count
from vibralake.session import small_side, written

WINDOW = 2048
BUCKETS = 8
BUDGET = 65_536


def pieces(docs: DataFrame, window: int = WINDOW, tokens: str | None = None) -> DataFrame:
    """doc_id, piece, first_token, n_tokens: every text in runs of at most ``window`` tokens."""
    count = F.coalesce(F.col(tokens).cast("long"), F.lit(0).cast("long")) if tokens else word_count("text")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), count.alias("total")).filter("total > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(window).cast("long"))
    cut = sized.select("doc_id", "total", F.posexplode(starts).alias("piece", "first_token"))
    return cut.select(
        "doc_id", F.col("piece").cast("long").alias("piece"), "first_token",
        F.least(F.lit(window).cast("long"), F.col("total") - F.col("first_token")).alias("n_tokens"),
    )


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket bounds with the least padding for an ascending histogram.

    Of equal choices the one whose lower bounds are smaller is taken.
    """
    n = len(lengths)
    if n == 0:
        return []
    held, words = np.cumsum(counts), np.cumsum(lengths * counts)
    before, sums = np.concatenate([[0], held]), np.concatenate([[0], words])
    # padding of lengths i..j in one bucket of bound lengths[j]
    padding = lengths[None, :] * (held[None, :] - before[:-1, None]) - (words[None, :] - sums[:-1, None])
    most = np.iinfo(np.int64).max // 4
    padding = np.where(np.arange(n)[:, None] <= np.arange(n)[None, :], padding, most)
    best, choices = padding[0], []
    for _ in range(min(buckets, n) - 1):
        total = np.concatenate([[most], best[:-1]])[:, None] + padding
        choices.append(np.argmin(total, axis=0))
        best = np.min(total, axis=0)
    bounds, end = [int(lengths[-1])], n - 1
    for choice in reversed(choices):
        end = int(choice[end]) - 1
        bounds.append(int(lengths[end]))
    return bounds[::-1]


def plan(cut: DataFrame, buckets: int, budget: int) -> DataFrame:
    """One row per length: n_tokens, bucket, bound, room (pieces per batch), below (shorter pieces of the bucket)."""
    rows = cut.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").collect()  # at most ``window`` rows
    lengths = np.array([r.n_tokens for r in rows], np.int64)
    counts = np.array([r.n for r in rows], np.int64)
    bounds = np.array(best_bounds(lengths, counts, buckets), np.int64)
    of = np.searchsorted(bounds, lengths)
    table = []
    for i, length in enumerate(lengths):
        below = counts[(of == of[i]) & (lengths < length)].sum()
        all_below = counts[lengths < length].sum()
        bound = int(bounds[of[i]])
        table.append((int(length), int(of[i]), bound, max(1, budget // bound), int(all_below - below)))
    schema = "n_tokens long, bucket int, bucket_length long, room long, skipped long"
    return cut.sparkSession.createDataFrame(table, schema)


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``place``, the row's place (from 0) in the order of ``keys`` over all rows.

    Places within a partition come from a range-partitioned sort, kept in files;
    the sizes of the partitions before are added.
    """
    sort = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    fixed = written(sort.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    fixed = fixed.withColumn("_part", F.shiftrightunsigned("_id", 33))
    sizes = fixed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = fixed.join(small_side(offsets), "_part")
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("place", F.col("_before") + inside).drop("_id", "_part", "_before")


def pack(
    docs: DataFrame, window: int = WINDOW, buckets: int = BUCKETS, budget: int = BUDGET, tokens: str | None = None
) -> DataFrame:
    """One row per piece.

    doc_id, piece, first_token, n_tokens, bucket, bucket_length, batch (from 0 in its
    bucket), slot (place in the batch), padding.
    """
    cut = written(pieces(docs, window, tokens), "pieces")
    table = plan(cut, buckets, budget)
    placed = ranked(cut, ["n_tokens", "doc_id", "piece"]).join(F.broadcast(table), "n_tokens")
    within = F.col("place") - F.col("skipped")
    return placed.select(
        "doc_id", "piece", "first_token", "n_tokens", "bucket", "bucket_length",
        F.floor(within / F.col("room")).alias("batch"), (within % F.col("room")).alias("slot"),
        (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
    )
