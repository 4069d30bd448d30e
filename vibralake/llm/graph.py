"""Connected components of large edge tables by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vibralake.session import written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id with an edge that is not itself a root.

    ``edges`` has two columns of one ordered type. The root is the smallest id reached. Rounds grow with the
    logarithm of the longest path; each is written, so a lost executor repeats one round.
    """
    a, b = edges.columns
    kept = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    kept, seen = written(kept, "edges"), None
    while True:
        sign = kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if sign == seen or sign[0] == 0:
            return kept.select(F.col("a").alias("id"), F.col("b").alias("root"))
        seen = sign
        kept = written(_small(_large(kept)), "edges")
