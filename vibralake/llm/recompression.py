"""Repeats of 50 words or more across documents, found by recompression.

Every text is a sequence of words, each named by its hash. A round of recompression
names runs of one symbol (symbol, length) and then pairs of neighbours, a left one and a right one, where
a coin thrown for each symbol and round says which it is. Names are hashes of what they stand
for, so all tasks give equal content equal names without asking each other: the global naming of a
round needs no exchange. After ``ROUNDS`` rounds equal passages have equal
symbols but near their borders.

How near is known exactly. Each symbol carries the stretch of words its making
depended on: its own, and those of a neighbour whose coin kept it from pairing. A symbol whose
stretch lies in a window is made alike wherever the window occurs, so its name may also take in the words of its
stretch. Each
window takes, of these symbols, the one of smallest name as its anchor; a window without any is its own
anchor, by its content. So equal windows have equal anchors.

Only then data moves. Anchors that several documents have are the shared high-level symbols; their
windows, named by two hashes over their words, are grouped to verify the repeat and find the
smallest document id, and windows with a smaller one elsewhere go back to their documents.
Documents with the same words all through are compared as one. Sums and minima combine before each shuffle;
joins on a hot name are split by adaptive execution.

Null texts have no words. Rows that repeat an id are taken to repeat the text, too; a null id has no order: nothing is removed
from such a document, and none for its sake.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vibralake.llm.texts import U64, Rolling, Slice, mapped, mix, owners, signed
from vibralake.session import written

WINDOW = 50
ROUNDS = 4
OVER_WORDS, OVER_WORDS_TOO = Rolling(31), Rolling(37)


def symbols(words: np.ndarray, bounds: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name and stretch [low, high) of each symbol after the rounds, over all rows of a slice.

    Both ends of the stretches ascend. What depends on the end of a row gets a stretch of one word beyond it, so that it
    lies in no window.
    """
    n = len(words)
    name, low, high = words.copy(), np.arange(n), np.arange(1, n + 1)
    row = owners(bounds)
    floor, ceiling = bounds[:-1] - 1, bounds[1:] + 1
    for round_ in range(rounds):
        if not len(name):
            break
        # runs: a run's name depends on both neighbours, which end it
        start = np.ones(len(name), bool)
        start[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(start)
        size = np.diff(np.append(first, len(name)))
        last = first + size - 1
        many = size > 1
        run = np.where(many, mix(name[first] * U64(3) + mix(size.astype(U64) + U64(round_ << 32))), name[first])
        # a single symbol is kept from being a run by its neighbours' names, a run by those beyond it; what
        # is needed of a neighbour is its name only, that is its stretch
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(name) - 1)
        inner_low, inner_high = low[first], high[last]
        left_open = (first > 0) & (row[before] == row[first])
        right_open = (last + 1 < len(name)) & (row[after] == row[last])
        run_low = np.where(left_open, np.minimum(low[before], inner_low), inner_low - 1)
        run_high = np.where(right_open, np.maximum(high[after], inner_high), inner_high + 1)
        name, row, low_here, high_here = run, row[first], run_low, run_high
        # pairs: left symbols take the right symbol that follows
        coin = (mix(name + U64((round_ + 1) * 0x9E3779B97F4A7C15 % 2**64)) & U64(1)).astype(bool)  # True: left
        m = len(name)
        together = np.zeros(m, bool)
        together[:-1] = coin[:-1] & ~coin[1:] & (row[:-1] == row[1:])
        second = np.zeros(m, bool)
        second[1:] = together[:-1]
        # an unpaired left symbol depends on what follows, an unpaired right one on what precedes
        follow, precede = np.minimum(np.arange(m) + 1, m - 1), np.maximum(np.arange(m) - 1, 0)
        has_next = np.zeros(m, bool)
        has_next[:-1] = row[:-1] == row[1:]
        has_before = np.zeros(m, bool)
        has_before[1:] = row[:-1] == row[1:]
        next_high = np.where(has_next, high_here[follow], high_here + 1)
        before_low = np.where(has_before, low_here[precede], low_here - 1)
        alone_low = np.where(coin, low_here, np.minimum(low_here, before_low))
        alone_high = np.where(coin, np.maximum(high_here, next_high), high_here)
        partner = follow
        pair_name = mix(name * U64(5) + mix(name[partner] + U64(round_ << 40) + U64(1)))
        new_name = np.where(together, pair_name, name)
        new_low = np.where(together, low_here, alone_low)
        new_high = np.where(together, high_here[partner], alone_high)
        keep = ~second
        name, row = new_name[keep], row[keep]
        low, high = np.maximum(new_low[keep], floor[row]), np.minimum(new_high[keep], ceiling[row])
    return name, low, high


def window_hashes(words: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the windows that begin at the given words."""
    first, second = OVER_WORDS.sums(words), OVER_WORDS_TOO.sums(mix(words + U64(77)))
    return OVER_WORDS.of(first, start, start + size), OVER_WORDS_TOO.of(second, start, start + size)


def anchors(piece: Slice, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row and anchor's name of every window; all word hashes and the rows' bounds."""
    words, bounds = piece.word_names()
    rows = owners(bounds)
    start = np.flatnonzero(np.arange(len(words)) + window <= bounds[1:][rows]) if len(words) else np.zeros(0, np.int64)
    if not len(start):
        return start, start, np.zeros(0, U64), words, bounds
    name, low, high = symbols(words, bounds, rounds)
    if len(name):  # with the words of its stretch, a symbol is as rare as a passage of that length
        over = OVER_WORDS.sums(words)
        name = mix(name + OVER_WORDS.of(over, np.maximum(low, 0), np.minimum(high, len(words))))
    a = np.searchsorted(low, start, "left")
    b = np.searchsorted(high, start + window, "right")
    wide = b - a
    best = np.zeros(len(start), U64)
    # least name over [a, b), by tables of doubling width
    table, width = name, 1
    some = wide > 0
    while some.any():
        now = some & (wide < 2 * width)
        best[now] = np.minimum(table[a[now]], table[b[now] - width])
        some &= ~now
        if some.any():
            table = np.minimum(table[:-width], table[width:])
            width *= 2
    none = wide <= 0
    if none.any():
        best[none] = mix(window_hashes(words, start[none], window)[0] + U64(9))
    return rows[start], start - bounds[:-1][rows[start]], best, words, bounds


def rows_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def named_anchors(plain: DataFrame, window: int, rounds: int) -> DataFrame:
    """(name, doc_id): the anchors of every document, each once."""

    def names(piece: Slice) -> pa.RecordBatch:
        row, _, name, _, _ = anchors(piece, window, rounds)
        order = np.lexsort((name, row))
        row, name = row[order], name[order]
        fresh = np.ones(len(name), bool)
        fresh[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
        return rows_of(name=signed(name[fresh]), doc_id=piece.rows.column("doc_id").take(pa.array(row[fresh])))

    return written(plain.filter("doc_id is not null").mapInArrow(mapped(names, "text"), "name long, doc_id long"), "names")


def words_digest(piece: Slice) -> list[bytes]:
    """SHA-256 of every row's words joined by one space."""
    starts, ends, bounds = piece.words()
    return [hashlib.sha256(kept_bytes(piece.data, starts[a:b], ends[a:b])).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def kept_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words between the given bytes, joined by one space."""
    if not len(starts):
        return b""
    length = ends - starts + 1  # with the space that follows
    total = int(length.sum())
    first = np.cumsum(length) - length
    at = np.arange(total) - np.repeat(first - starts, length)
    out = data[np.minimum(at, len(data) - 1)].copy()
    out[np.cumsum(length) - 1] = 32
    return out[:-1].tobytes()


def removed(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def describe(piece: Slice) -> pa.RecordBatch:
        _, _, bounds = piece.words()
        return rows_of(doc_id=piece.rows.column("doc_id"), n_words=pa.array(np.diff(bounds).astype(np.int64)), digest=pa.array(words_digest(piece), pa.binary()))

    known = written(plain.mapInArrow(mapped(describe, "text"), "doc_id long, n_words long, digest binary"), "words")
    first = written(known.groupBy("digest").agg(F.min("doc_id").alias("first_id")), "first")

    named = named_anchors(plain, window, rounds)
    # written, so that both sides of the joins are plain exchanges, whose hot keys Spark splits
    several = named.groupBy("name").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x < y")
    shared = written(several.select("name"), "shared")
    with_shared = named.join(shared, "name").groupBy("doc_id").agg(F.collect_set("name").alias("shared"))
    leaders = first.select(F.col("first_id").alias("doc_id")).distinct()
    some = written(plain.join(with_shared.join(leaders, "doc_id", "left_semi"), "doc_id"), "candidates")

    def windows(piece: Slice) -> pa.RecordBatch:
        row, place, name, words, bounds = anchors(piece, window, rounds)
        lists = piece.rows.column("shared")
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        values = lists.flatten().to_numpy().view(U64)
        # a window is in question if its own row lists its anchor
        key = mix(name + mix(row.astype(U64)))
        listed = np.isin(key, mix(values + mix(owner.astype(U64))))
        row, place = row[listed], place[listed]
        one, two = window_hashes(words, bounds[:-1][row] + place, window)
        return rows_of(one=signed(one), two=signed(two), doc_id=piece.rows.column("doc_id").take(pa.array(row)), place=pa.array(place.astype(np.int32)))

    asked = written(some.mapInArrow(mapped(windows, "text"), "one long, two long, doc_id long, place int"), "windows")
    least = asked.groupBy("one", "two").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x < y")
    least = written(least.select("one", "two", "x"), "least")
    gone = asked.join(least, ["one", "two"]).filter("doc_id > x").groupBy("doc_id").agg(F.collect_list("place").alias("places"))

    def cut(piece: Slice) -> pa.RecordBatch:
        starts, ends, bounds = piece.words()
        lists = piece.rows.column("places")
        offsets, values = lists.offsets.to_numpy(), lists.flatten().to_numpy().astype(np.int64)
        values = values + np.repeat(bounds[:-1], np.diff(offsets))
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, values, 1)
        np.add.at(change, values + window, -1)
        covered = np.cumsum(change)[:-1] > 0
        n = [int(covered[a:b].sum()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        sha = [
            hashlib.sha256(kept_bytes(piece.data, starts[a:b][~covered[a:b]], ends[a:b][~covered[a:b]])).hexdigest()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True)
        ]
        return rows_of(_id=piece.rows.column("doc_id"), n_removed=pa.array(n, pa.int64()), kept=pa.array(sha))

    texts = some.select("doc_id", "text").join(gone, "doc_id")
    parts = texts.mapInArrow(mapped(cut, "text"), "_id long, n_removed long, kept string")
    parts = parts.groupBy("_id").agg(F.min("n_removed").alias("n_removed"), F.min("kept").alias("kept"))
    rows = known.join(first, "digest").join(parts, F.col("doc_id") == F.col("_id"), "left")
    copy = (F.col("n_words") >= window) & (F.col("doc_id") > F.col("first_id"))
    nothing = F.sha2(F.lit(""), 256)
    return rows.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, nothing).otherwise(F.coalesce("kept", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )
