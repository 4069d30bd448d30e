"""Insert-or-replace by key on plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vibralake.session import written

# Folders of a keyed table.
BUCKETS = 64
# Parts of a folder while an upsert shuffles.
PARTS = 8
# Of its files, which hold texts.
PACKED = {"compression": "zstd"}


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` values of each key.

    ``row_number() <= 1`` is pruned inside every input partition before the
    shuffle, so a key that holds most rows sends one row per partition.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = (), near: Sequence[str] = ()) -> DataFrame:
    """``current`` with the rows of ``incoming`` put in by key.

    Incoming rows win over current ones; among incoming rows of one key the
    greatest ``order`` wins. Rows come out dealt by ``near``, columns that follow from the key.
    """
    stacked = current.withColumn("_new", F.lit(0)).unionByName(
        incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    dealt = stacked.repartition(*near) if near else stacked
    return latest_per_key(dealt, [*near, *keys], ["_new", *order]).drop("_new")


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The folder of a row: a hash of its key, so that no key range or category fills one folder."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_keyed(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Lay a keyed table down in ``bucket=`` folders."""
    placed = rows.withColumn("bucket", bucket_of(keys, buckets))
    placed.hint("rebalance", "bucket").write.mode("overwrite").options(**PACKED).partitionBy("bucket").parquet(path)


def upsert_keyed(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = (), buckets: int = BUCKETS) -> list[int]:
    """Put ``incoming`` into the keyed table at ``path``; only folders that get rows are read and written again.

    Returns the folders touched. The merged rows are written aside first and then replace their folders, each
    as a whole; run again after a failure, the same rows come out.
    """
    placed = written(incoming.withColumn("bucket", bucket_of(keys, buckets)), "incoming", **PACKED)
    touched = sorted(r["bucket"] for r in placed.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    if not touched:
        return []
    current = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
    part = F.pmod(F.xxhash64(F.lit("part"), *keys), F.lit(PARTS)).cast("int")
    # rows meet by folder and part, so that a merged file holds few folders and is not shuffled again to be laid down
    every = upsert(current.withColumn("_part", part), placed.withColumn("_part", part), keys, order, ["bucket", "_part"])
    merged = written(every.select(*current.columns), "merged", **PACKED)
    merged.write.mode("overwrite").options(**PACKED).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")
