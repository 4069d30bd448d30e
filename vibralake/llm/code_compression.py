"""Product codes of vectors, with codebooks refined by exact integer rounds over Hilbert-sorted blocks.

A vector of integers is cut into consecutive parts, and every part position has a codebook. The sub-vectors of
a position are sorted along a Hilbert curve and laid down as flat blocks of ``BLOCK`` neighbours. A block stores its rows,
its box (least and greatest value per component) and the sums of its components. A round compares each box with
the codebook: an entry stays on the block's shortlist only if its least distance to the box does not exceed the
greatest distance of any other entry, and if no other entry is nearer in every point of the box. A
block whose shortlist has one entry adds its sums whole; the others go through a small integer kernel over
the shortlist alone. Distances are exact 64-bit integers and ties go to the lower index, so neither the order nor the
cut of the blocks changes a result.

Equal sub-vectors are told apart by their row in the sort, so a vector that a third of the rows share is dealt to many
tasks; its blocks have boxes of one point. A round brings entries x width sums to the driver, never rows.

Defined results: vectors that are null or hold null or non-finite components are dropped. Rows that repeat an id, or have
none, are rows of their own; among the first entries null ids come last and rows of one id are ordered by their vector. With fewer
rows than entries the codebook is that much smaller. Vectors of different widths share no codebook and are compressed apart, at most
``WIDTHS`` of them; a width that the number of parts does not divide is cut as evenly as may be. Components so far apart that
a squared distance might pass 2**62 raise ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vibralake.session import small_side, written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK = 256
WIDTHS = 64
# Bits of a Hilbert key.
KEY_BITS = 62

BLOCK_SCHEMA = "part int, n int, rows binary, members binary, low binary, high binary, sums binary"


def finite(vector: str) -> Column:
    """Whether an array is there and holds finite numbers only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def integers(vector: str, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def cuts(width: int, parts: int) -> list[int]:
    """Bounds of the parts of a vector."""
    return [j * width // parts for j in range(parts + 1)]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of unsigned cell numbers below 2**bits."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = np.int64((1 << level) - 1)
        for i in range(dims):
            turned = (x[i] >> level) & 1 == 1
            swapped = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swapped)
            x[i] ^= swapped
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, np.int64((1 << level) - 1), np.int64(0))
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def flat(held: bytes, n: int) -> np.ndarray:
    """The ``n`` rows of a block's integers."""
    numbers = np.frombuffer(held, np.int64)
    return numbers.reshape(n, len(numbers) // n)


def blocks(rows: DataFrame, width: int, parts: int, spans: np.ndarray) -> DataFrame:
    """Flat blocks of the sub-vectors of rows (row long, v array<long>), one Hilbert order per part.

    ``spans`` holds two rows, the values of each component between which the curve's cells lie; values outside go to the
    cells at the edge.
    """
    bounds = cuts(width, parts)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, row = matrix(batch.column("v"), width), batch.column("row")
            for j in range(parts):
                dims = bounds[j + 1] - bounds[j]
                sub = np.ascontiguousarray(v[:, bounds[j] : bounds[j + 1]])
                key = np.zeros(len(sub), np.int64)
                if dims:
                    used = min(dims, KEY_BITS)
                    bits = min(16, KEY_BITS // used)
                    low, high = spans[:, bounds[j] : bounds[j] + used]
                    cell = np.floor((sub[:, :used] - low) / np.maximum(high - low, 1e-9) * (1 << bits))
                    key = hilbert(np.clip(cell, 0, (1 << bits) - 1), bits)
                offsets = np.arange(len(sub) + 1, dtype=np.int32) * (8 * dims)
                held = pa.BinaryArray.from_buffers(pa.binary(), len(sub), [None, pa.py_buffer(offsets), pa.py_buffer(sub.tobytes())])
                part = pa.array(np.full(len(sub), j, np.int32))
                yield pa.RecordBatch.from_arrays([part, pa.array(key), row, held], ["part", "key", "row", "sub"])

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, row = batch.column("part").to_numpy(), batch.column("row").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            made = []
            for a, b in zip(edges, edges[1:], strict=False):
                for start in range(a, b, BLOCK):
                    end = min(b, start + BLOCK)
                    held = b"".join(batch.column("sub").slice(start, end - start).to_pylist())
                    values = flat(held, end - start)
                    boxed = (values.min(axis=0), values.max(axis=0), values.sum(axis=0))
                    made.append((int(part[a]), end - start, row[start:end].tobytes(), held, *(x.tobytes() for x in boxed)))
            if made:
                names = ["part", "n", "rows", "members", "low", "high", "sums"]
                types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names)

    keys = ["part", "key", "row"]
    subs = rows.select("row", "v").mapInArrow(keyed, "part int, key long, row long, sub binary")
    ordered = subs.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(ordered.mapInArrow(laid, BLOCK_SCHEMA), "blocks")


def shortlist(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Entries of ``book`` that may be the nearest of some point in the box, in ascending order."""
    off = np.maximum(0, np.maximum(low - book, book - high))
    far = np.maximum(np.abs(book - low), np.abs(book - high))
    near, reach = (off * off).sum(axis=1), (far * far).sum(axis=1)
    left = np.flatnonzero(near <= reach.min())
    if len(left) < 2:
        return left
    # over the box, d(x, e) - d(x, f) is least at a corner that the sign of e - f names
    kept = book[left]
    apart = kept[:, None, :] - kept[None, :, :]
    corner = np.where(apart > 0, high, low)
    squares = (kept * kept).sum(axis=1)
    least = squares[:, None] - squares[None, :] - 2 * (apart * corner).sum(axis=2)
    return left[~(least > 0).any(axis=1)]


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, the lower one of equals, and its squared distance."""
    distance = np.zeros((len(values), len(book)), np.int64)
    for i in range(values.shape[1]):
        step = values[:, i, None] - book[None, :, i]
        distance += step * step
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(values)), best]


def boxed(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[tuple]:
    """(block, its part, its shortlist) for every stored block."""
    for batch in batches:
        for block in batch.to_pylist():
            book = books[block["part"]]
            low, high = (np.frombuffer(block[name], np.int64) for name in ("low", "high"))
            yield block, block["part"], shortlist(low, high, book)


def shortlists(held: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """part, n, entries: what the boxes leave of the codebook for each block."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [(part, block["n"], len(left)) for block, part, left in boxed(batches, books)]
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*made, strict=True)], ["part", "n", "entries"])

    return held.select("part", "n", "low", "high").mapInArrow(sizes, "part int, n int, entries int")


def refined(held: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round; entries that no sub-vector is nearest to stay."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]  # the last column counts
        for block, part, left in boxed(batches, books):
            if len(left) == 1:
                sums[part][left[0], :-1] += np.frombuffer(block["sums"], np.int64)
                sums[part][left[0], -1] += block["n"]
                continue
            values = flat(block["members"], block["n"])
            best, _ = nearest(values, books[part][left])
            for k, entry in enumerate(left.tolist()):
                mine = best == k
                sums[part][entry, :-1] += values[mine].sum(axis=0)
                sums[part][entry, -1] += mine.sum()
        for part, table in enumerate(sums):
            entry, place = np.indices(table.shape).reshape(2, -1).astype(np.int32)
            columns = [pa.array(np.full(table.size, part, np.int32)), pa.array(entry), pa.array(place), pa.array(table.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "place", "total"])

    partial = held.select("part", "n", "members", "low", "high", "sums").mapInArrow(tally, "part int, entry int, place int, total long")
    totals = partial.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()  # entries x (width + parts) rows
    out = [b.copy() for b in books]
    tables = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
    for r in totals:
        tables[r.part][r.entry, r.place] = r.total
    for book, table in zip(out, tables, strict=True):
        used = table[:, -1] > 0
        book[used] = table[used, :-1] // table[used, -1:]
    return out


def assigned(held: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """row, part, entry, distance of every sub-vector."""

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part, left in boxed(batches, books):
            values = flat(block["members"], block["n"])
            best, distance = nearest(values, books[part][left])
            columns = [np.frombuffer(block["rows"], np.int64), np.full(block["n"], part, np.int32), left[best].astype(np.int32), distance]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "part", "entry", "distance"])

    return held.select("part", "n", "rows", "members", "low", "high").mapInArrow(final, "row long, part int, entry int, distance long")


@dataclass
class Codes:
    """rows: id, label, code, error; books: the final codebooks per vector width, one matrix per part."""

    rows: DataFrame
    books: dict[int, list[np.ndarray]]

    def digest(self, width: int) -> str:
        """SHA-256 of a width's components in decimal, by part, entry and place."""
        numbers = [str(x) for book in self.books[width] for x in book.ravel().tolist()]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compress(
    table: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> Codes:
    """Codes of every usable row of ``table``: id, label, width, code (two hex digits a part), error (squared distance)."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part: at most 256 entries")
    columns = [F.col(id_).alias("id"), F.col(label).alias("label"), integers(vector, scale).alias("v")]
    rows = table.filter(finite(vector)).select(*columns).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows.withColumn("width", F.size("v")), "vectors")
    widths = [r.width for r in rows.select("width").distinct().limit(WIDTHS + 1).collect()]
    if len(widths) > WIDTHS:
        raise ValueError(f"vectors of more than {WIDTHS} widths")
    made, books = [], {}
    for width in sorted(widths):
        mine = rows.filter(F.col("width") == width)
        first = mine.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
        start = np.array([r.v for r in first], np.int64).reshape(len(first), width)
        book = [start[:, a:b].copy() for a, b in zip(cuts(width, parts), cuts(width, parts)[1:], strict=False)]
        held = blocks(mine, width, parts, spans(mine, width))
        for _ in range(rounds):
            before, book = book, refined(held, book)
            if all(np.array_equal(a, b) for a, b in zip(before, book, strict=True)):
                break  # further rounds change nothing
        books[width] = book
        found = assigned(held, book).groupBy("row").agg(
            *[F.max(F.when(F.col("part") == j, F.col("entry"))).alias(f"e{j}") for j in range(parts)],
            F.sum("distance").alias("error"),
        )
        code = F.concat(*[F.lower(F.lpad(F.hex(f"e{j}"), 2, "0")) for j in range(parts)])
        made.append(found.select("row", code.alias("code"), "error"))
    if not made:
        empty = rows.withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")})
        return Codes(empty.select("id", "label", "width", "code", "error"), {})
    coded = made[0]
    for more in made[1:]:
        coded = coded.unionByName(more)
    return Codes(rows.select("row", "id", "label", "width").join(coded, "row").drop("row"), books)


def spans(rows: DataFrame, width: int) -> np.ndarray:
    """Where most values of each component lie: three deviations around the mean.

    Also proves that squared distances stay below 2**62.
    """
    each = rows.select(F.posexplode("v").alias("place", "x")).groupBy("place")
    found = each.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread"), F.min("x").alias("low"), F.max("x").alias("high"))
    out, least, most = np.zeros((2, width)), 0, 0
    for r in found.collect():  # one row per component
        out[:, r.place] = r.mean - 3 * r.spread, r.mean + 3 * r.spread
        least, most = min(least, r.low), max(most, r.high)
    if max(width, 1) * (most - least) ** 2 >= 2**62:
        raise ValueError("components are too far apart for exact 64-bit distances")
    return out


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add label_error, the errors summed over equal labels, null being one."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return coded.join(small_side(sums), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
