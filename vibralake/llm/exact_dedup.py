"""Exact duplicates through an extendible-hash index kept in shared files.

The index maps a text to its group. An entry holds the hash of the text (its
pseudo key), the place in the chain of entries that share this key, the key of the
row that stays, the size of the group and the text's digest. A directory says to
which bucket, a prefix of the key's bits, an entry belongs. It starts with few
bits; every bucket that holds more entries than it may is split by the next bit, which
doubles the directory, until none is overfull. Entries and directory lie as
parquet in the folder all executors share, sorted by key, each owner task writing
one range of keys.

* Copies combine before the shuffle and by their bytes: equal keys are grouped
  on key and text, so a text that fills a third of the rows leaves every task as
  one row, and two texts of one key become two entries of a chain.
* Looking a row up joins on key and digest with a table that has one row for each
  distinct text. Adaptive execution splits a hot key there.

Null text counts as empty. Rows that repeat an id share one fate; a null id stays
only in a group without other ids. Further columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vibralake.llm.texts import lower_ascii, unused
from vibralake.session import written

CAPACITY = 20_000
MAX_BITS = 60


@dataclass
class Index:
    """``entries``: key, chain, keep_id, group_size, text_sha256, bucket, depth; ``directory``: bucket, depth, held."""

    entries: DataFrame
    directory: DataFrame


def normalised(text: str = "text") -> Column:
    return lower_ascii(F.coalesce(F.col(text), F.lit("")))


def keyed(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Id, normalised text and pseudo key; fewer ``bits`` force collisions, for tests."""
    key = F.xxhash64("norm")
    if bits < 64:
        key = F.shiftleft(F.shiftrightunsigned(key, 64 - bits), 64 - bits)
    plain = docs.select(F.col("doc_id"), normalised().alias("norm"))
    return plain.withColumn("key", key)


def prefix(depth: int) -> Column:
    """The first ``depth`` bits of the key as a number."""
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def split_buckets(entries: DataFrame, capacity: int) -> DataFrame:
    """Directory: split overfull buckets, one bit more each time, until none is left.

    Starts at the depth at which evenly filled buckets would hold between one
    and two times the capacity. A bucket whose entries share every bit cannot be
    split; its chain just grows.
    """
    spark = entries.sparkSession
    total = entries.count()
    depth = max(0, (max(total, 1) // capacity).bit_length() - 1)
    done, open_ = [], entries.select("key")
    while True:
        held = written(open_.groupBy(prefix(depth).alias("bucket")).agg(F.count("*").alias("held")), "directory")
        full = (F.col("held") > capacity) & F.lit(depth < MAX_BITS)
        done.append(held.filter(~full).select("bucket", F.lit(depth).alias("depth"), "held"))
        overfull = held.filter(full)
        if overfull.isEmpty():
            break
        open_ = open_.join(overfull.select("bucket"), prefix(depth) == F.col("bucket"), "left_semi")
        depth += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return spark.createDataFrame([], out.schema) if total == 0 else out


def build(docs: DataFrame, capacity: int = CAPACITY, bits: int = 64) -> Index:
    """Group rows by their bytes and lay the groups down as an index."""
    spark = docs.sparkSession
    groups = keyed(docs, bits).groupBy("key", "norm").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    small = groups.select("key", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256"))
    chain = F.row_number().over(Window.partitionBy("key").orderBy("text_sha256")) - 1
    entries = written(small.withColumn("chain", chain), "entries")
    directory = written(split_buckets(entries, capacity), "directory")
    placed = None
    for depth in [r.depth for r in directory.select("depth").distinct().collect()]:  # at most MAX_BITS values
        level = directory.filter(F.col("depth") == depth)
        part = entries.join(level.drop("held"), prefix(depth) == F.col("bucket"))
        placed = part if placed is None else placed.unionByName(part)
    if placed is None:
        placed = entries.withColumns({"bucket": F.lit(0).cast("long"), "depth": F.lit(0)})
    owned = placed.repartitionByRange("key").sortWithinPartitions("key", "chain")
    return Index(written(owned, "index"), directory)


def lookup(docs: DataFrame, index: Index, bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket, depth, chain."""
    rows = keyed(docs, bits).select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256"))
    found = rows.join(index.entries, ["key", "text_sha256"])
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256", "bucket", "depth", "chain",
    )


def deduplicate(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per document that tells its group and whether it stays."""
    return lookup(docs, build(docs, capacity))


def survivors(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The documents that stay, with their columns; rows that repeat id and text stay once."""
    id_, kept, own = (unused(docs, name) for name in ("_id", "_kept", "_digest"))
    stay = deduplicate(docs, capacity).filter("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(kept)).distinct()
    rows = docs.withColumn(own, F.sha2(normalised(), 256))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(kept))
    return rows.join(stay, same, "left_semi").dropDuplicates(["doc_id", own]).select(docs.columns)
