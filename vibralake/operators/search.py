"""Text search over chunks by the cosine of exact term weights.

The index is a table of shards (``postings``), written once and searched any number of times. Texts
are not shuffled to build it: a task makes shards of the rows it reads, and only each shard's vocabulary
travels, to learn how many chunks have a term. A search brings the queries to the shards; a task returns at
most n chunks per query and shard, so a word that every chunk has makes no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from vibralake import domain
from vibralake.functions import text as tx
from vibralake.operators import postings, topk
from vibralake.session import discard, small_side, written, written_parts

WORDS = r"[^\p{L}]+"
EVERY = "\x00all"


# Bytes of words in a shard.
SHARD_BYTES = 4 << 20
# A shard is one long row: a task that writes or reads shards holds a row group, and left alone Parquet looks at a group's size after 100 rows only.
# Shards meet their terms in so many parts at most, of so many bytes at least: only a part is shuffled at a time.
MEETINGS, MEETING_BYTES = 8, 256 << 20
SHARD_FILES = {"parquet.block.row.count.limit": 1, "compression": "zstd"}
# Queries, and bytes of their terms, that are sent to all tasks.
FEW_QUERIES = 4_096
FEW_BYTES = 32 << 20


class Index(NamedTuple):
    """``shards`` to search, ``terms``: term, idf; ``items``: key, group; number of items."""

    shards: DataFrame
    terms: DataFrame
    items: DataFrame
    size: int


def idf(seen: Column, size: int) -> Column:
    """ln((n + 1) / (df + 1))."""
    return F.log((F.lit(size) + 1.0) / (seen + 1.0))


def one_row(values: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of a single row; lists may be given as Arrow arrays."""

    def column(value: object, kind: pa.DataType) -> pa.Array:
        value = value.values if isinstance(value, pa.ListScalar) else value
        if isinstance(value, pa.Array):
            return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value.cast(kind.value_type))
        return pa.array([value.as_py() if isinstance(value, pa.Scalar) else value], kind)

    return pa.RecordBatch.from_arrays([column(values[f.name], f.type) for f in schema], schema=schema)


def gathered(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Raw shards of the rows (key, group, words) of a task."""
    held, size, number = [], 0, TaskContext.get().partitionId() << 32

    def shard() -> pa.RecordBatch:
        nonlocal held, size, number
        rows = pa.Table.from_batches(held).combine_chunks()
        made = postings.counted(*(rows[c].chunk(0) for c in ("key", "group", "words")))
        made, held, size, number = {"shard": number} | made, [], 0, number + 1
        return one_row(made, schema)

    for batch in batches:
        # a batch of long rows is cut, so that a shard is not much over its size
        step = max(1, int(batch.num_rows * SHARD_BYTES / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            held.append(batch.slice(at, step))
            size += batch.nbytes * held[-1].num_rows // batch.num_rows
            if size >= SHARD_BYTES:
                yield shard()
    if held:
        yield shard()


def finished(held: pa.Table, found: pa.Table, schema: pa.Schema) -> pa.Table:
    """The searchable shard of a raw one, given the places and idf of its terms."""
    row = {n: held[n][0] for n in held.column_names}
    weights = np.zeros(len(row["vocabulary"]))
    weights[found["place"].to_numpy()] = found["idf"].to_numpy()
    raw = {n: row[n].as_py() for n in ("bounds", "term", "tf")}
    made = raw | {"idf": weights.tobytes(), "order": postings.weighed(raw, weights)["order"]}
    made |= {n: row[n] for n in ("shard", "keys", "groups", "vocabulary")}
    return pa.Table.from_batches([one_row(made, schema)])


def shard_types(key: DataType, numbers: dict[str, str]) -> tuple[str, pa.Schema]:
    """Columns of a shard table, for Spark and for Arrow."""
    ddl = f"shard long, keys array<{key.simpleString()}>, groups array<string>, vocabulary array<string>"
    fields = [("shard", pa.int64()), ("keys", pa.list_(to_arrow_type(key))), ("groups", pa.list_(pa.string())), ("vocabulary", pa.list_(pa.string()))]
    kinds = {"binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    return ", ".join([ddl, *(f"{n} {t}" for n, t in numbers.items())]), pa.schema(fields + [(n, kinds[t]) for n, t in numbers.items()])


def build_index(
    chunks: DataFrame, key: str = "chunk_id", text: str = "text", group: str | None = None, pattern: str = WORDS
) -> Index:
    """Index of all chunks, written once; ``group`` is what searches filter by.

    Keys are those of a collection: rows that repeat one are items of their own, rows without one are left out.
    """
    named = F.col(group).cast("string") if group is not None else F.lit(None).cast("string")
    words = F.coalesce(tx.tokens(F.col(text), pattern), F.array().cast("array<string>"))
    rows = chunks.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), named.alias("group"), words.alias("words"))
    kind = rows.schema["key"].dataType
    ddl, schema = shard_types(kind, {"df": "array<int>", "bounds": "binary", "term": "binary", "tf": "binary"})
    raw = written(rows.mapInArrow(partial(gathered, schema=schema), ddl), "raw_shards", **SHARD_FILES)
    bytes_ = F.octet_length("bounds") + F.octet_length("term") + F.octet_length("tf")
    made = raw.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("n"), F.coalesce(F.sum(bytes_), F.lit(0)).alias("bytes")).first()
    size, meetings = made["n"], min(MEETINGS, -(-made["bytes"] // MEETING_BYTES))

    zipped = F.posexplode(F.arrays_zip("vocabulary", "df")).alias("place", "x")
    each = raw.select("shard", zipped).select("shard", "place", F.col("x.vocabulary").alias("term"), F.col("x.df").alias("df"))
    terms = written(each.groupBy("term").agg(idf(F.sum("df"), size).alias("idf")), "terms")
    # shards by number, so that a file's other row groups are passed over
    shares = [i / meetings for i in range(1, meetings)]
    cuts = sorted(set(raw.agg(F.percentile_approx("shard", shares, 10_000).alias("x")).first()["x"])) if shares else []
    ddl, schema = shard_types(kind, dict.fromkeys(postings.STORED, "binary"))

    def finish(held: pa.Table, found: pa.Table) -> pa.Table:
        return finished(held, found, schema)

    def meeting(low: int | None, high: int | None) -> DataFrame:
        """The shards whose numbers are over ``low`` and up to ``high``."""
        own = (F.lit(True) if low is None else F.col("shard") > low) & (F.lit(True) if high is None else F.col("shard") <= high)
        found = each.filter(own).join(terms, "term").select(F.col("shard").alias("of_shard"), "place", "idf")
        # a shard's terms meet it as sorted rows; gathered in an array each would be an object of the executor
        return raw.drop("df").filter(own).groupBy("shard").cogroup(found.groupBy("of_shard")).applyInArrow(finish, ddl)

    shards = written_parts((meeting(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)), "shards", **SHARD_FILES)
    discard(raw)
    items = shards.select(F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("groups").alias("group"))))
    return Index(shards, terms, items, size)


def query_terms(queries: DataFrame, index: Index, query_id: str, text: str, group: str | None, pattern: str) -> DataFrame:
    """``(query_id, wanted, terms, shares)`` with unit length per query; words no chunk has count for the length."""
    words = queries.select(query_id, F.explode(tx.tokens(F.col(text), pattern)).alias("term"))
    asked = words.groupBy(query_id, "term").agg(F.count("*").alias("tf"))
    known = index.terms.join(small_side(words.select("term").distinct()), "term")
    weighed = asked.join(known, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", idf(F.lit(0), index.size)))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(query_id)))
    shared = weighed.withColumn("share", F.try_divide("w", length)).filter("share > 0")  # a word that every chunk has weighs nothing
    packed = F.sort_array(F.collect_list(F.struct("term", "share"))).alias("x")
    each = shared.groupBy(F.col(query_id).alias("query_id")).agg(packed)
    wanted = F.col(group).cast("string") if group is not None else F.lit(None).cast("string")
    every = queries.select(F.col(query_id).alias("query_id"), wanted.alias("wanted"))
    return every.join(each, "query_id").select("query_id", "wanted", F.col("x.term").alias("terms"), F.col("x.share").alias("shares"))


def in_shards(index: Index, asked: DataFrame, n: int, few: int = FEW_QUERIES, costs: bool = False) -> DataFrame:
    """What every shard has to say on every query: (query_id, item_id, score), or (query_id, read, postings) with ``costs``.

    Few queries are sent to the tasks that read the shards. More than ``few`` are dealt into pieces that meet the shards by key; a
    task then sees one piece and the shards of one cell, a few.
    """
    asked = written(asked, "asked")
    q, i = asked.schema["query_id"].dataType, index.shards.schema["keys"].dataType.elementType
    ddl, fields = ("read long, postings long", [("read", pa.int64()), ("postings", pa.int64())]) if costs else (
        f"item_id {i.simpleString()}, score double", [("item_id", to_arrow_type(i)), ("score", pa.float64())])
    ddl, schema = f"query_id {q.simpleString()}, {ddl}", pa.schema([("query_id", to_arrow_type(q)), *fields])
    width = F.coalesce(F.sum(F.aggregate("terms", F.lit(0), lambda a, t: a + F.octet_length(t) + 8)), F.lit(0))
    total = asked.agg(F.count("*").alias("rows"), width.alias("bytes")).first()

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield {name: batch.column(name)[row] for name in batch.schema.names}

    if total["rows"] <= few and total["bytes"] <= FEW_BYTES:
        shared = asked.sparkSession.sparkContext.broadcast(asked.toArrow())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from postings.answers(rows_of(batches), shared.value, n, costs, schema)

        return index.shards.mapInArrow(scan, ddl)

    cells = max(1, index.shards.count())
    pieces = max(-(-total["rows"] // max(1, few)), -(-total["bytes"] // FEW_BYTES))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = index.shards.withColumn("_cell", F.pmod(F.xxhash64("shard"), F.lit(cells)).cast("int")).withColumn("_piece", every(pieces))
    right = asked.withColumn("_piece", F.pmod(F.xxhash64("query_id"), F.lit(pieces)).cast("int")).withColumn("_cell", every(cells))

    def meet(shards: pa.Table, held: pa.Table) -> pa.Table:
        found = postings.answers(rows_of(iter(shards.to_batches())), held, n, costs, schema) if held.num_rows else []
        return pa.Table.from_batches(list(found), schema=schema)

    return left.groupBy("_cell", "_piece").cogroup(right.groupBy("_cell", "_piece")).applyInArrow(meet, ddl)


def search_cost(
    queries: DataFrame, index: Index, n: int = domain.CONTEXT_CHUNKS, query_id: str = "query_id", text: str = "query_text",
    group: str | None = None, pattern: str = WORDS,
) -> DataFrame:
    """``(query_id, read, postings)``: the postings that a search reads, and all that its terms have."""
    each = in_shards(index, query_terms(queries, index, query_id, text, group, pattern), n, costs=True)
    return each.groupBy("query_id").agg(F.sum("read").alias("read"), F.sum("postings").alias("postings"))


def first_items(index: Index, n: int, grouped: bool) -> DataFrame:
    """``(cell, item_id)``: the ``n`` lowest keys of each group and of all, for queries that match too little."""
    lowest = index.items.orderBy("key").limit(n).select(F.lit(EVERY).alias("cell"), F.col("key").alias("item_id"))
    if not grouped:
        return lowest
    order = F.row_number().over(Window.partitionBy("group").orderBy("key"))
    mine = index.items.filter("group is not null").withColumn("_n", order).filter(F.col("_n") <= n)
    return lowest.unionByName(mine.select(F.col("group").alias("cell"), F.col("key").alias("item_id")))


def search(
    queries: DataFrame,
    index: Index,
    n: int = domain.CONTEXT_CHUNKS,
    query_id: str = "query_id",
    text: str = "query_text",
    group: str | None = None,
    pattern: str = WORDS,
    few: int = FEW_QUERIES,
) -> DataFrame:
    """``(query_id, item_id, score, rank)``: the n best chunks of each query.

    With ``group`` a query sees only chunks of its group; a null group sees all. Queries that
    match fewer than n chunks get those of the lowest ids with score 0.
    """
    asked = query_terms(queries, index, query_id, text, group, pattern)
    best = topk.rank(in_shards(index, asked, n, few), n).select("query_id", "item_id", "score")
    cell = F.coalesce(F.col(group).cast("string"), F.lit(EVERY)) if group is not None else F.lit(EVERY)
    # of 2n lowest ids at least n are no hits where hits are fewer than n
    lowest = small_side(first_items(index, 2 * n, group is not None))
    fill = queries.select(F.col(query_id).alias("query_id"), cell.alias("cell")).join(lowest, "cell")
    every = best.unionByName(fill.select("query_id", "item_id", F.lit(0.0).alias("score")))
    return topk.rank(every.groupBy("query_id", "item_id").agg(F.max("score").alias("score")), n)


def with_chunk_text(found: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Search hits with text and metadata; the score has three decimals."""
    hits = written(found, "hits").withColumnRenamed("item_id", key).withColumn("score", F.round("score", 3))
    return chunks.join(hits, key)
