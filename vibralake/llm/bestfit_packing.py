"""Vector best-fit packing of token pieces into sequences.

A document's tokens, closed by an end token, are cut into pieces of at most ``window`` tokens. A sequence has three capacities: tokens, documents
(pieces) and attention cost (the sum of squared piece lengths). Pieces go in by falling length. Of the open sequences with room in every dimension a piece
takes the one with the least residual norm after it (``rule="norm"``: weighted squares of what is left, as shares of the
capacities) or the least weighted dot product of its needs and the residual (``rule="dot"``); of equals the one opened first. If none has room, a new one
is opened. Under both rules the sequence that took a piece stays the best for the next piece of that length until it lacks room.

Pieces of one length are alike, so the choice needs nothing but the histogram of lengths, at most ``window`` rows, and runs over ranges of
sequences that are filled alike: a range takes as many pieces of a length as fit, in one step. The steps are exactly those of placing one
piece after another. They come out as runs: from which place among the pieces of a length on, which sequences take how many each,
and at what offset. A range-partitioned sort gives every piece its place, and a lookup in the runs its sequence; no task sees
all pieces of a length, however many there are. The number of runs depends on the window alone.

Defined results: a null text counts as empty, and an empty one is its end token alone. Rows that repeat an id, or have none, are documents of their own. Other
columns of the documents are not read; other columns of the pieces ride along. An empty table has no pieces. A piece length that does not fit an empty sequence raises
ValueError. Texts are tokenised stretch by stretch, and whole: a text has to fit a worker's memory, with some twenty bytes a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vibralake.llm.packing import ranked
from vibralake.llm.texts import Slice, mapped
from vibralake.llm.token_pieces import WordIds, stretches, tokenizer_path
from vibralake.session import written

WINDOW = 2048
VOCABULARY = "word_bpe_49k.json"
END = 0
# Text that is tokenised at a time.
SLICE_BYTES = 4 << 20
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most, and the weight of each dimension."""

    tokens: int = WINDOW
    documents: int = WINDOW
    attention: int = WINDOW * WINDOW
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)


def needs(length: int) -> np.ndarray:
    return np.array([length, 1, length * length], np.int64)


@cache
def encoder(vocabulary: str) -> WordIds:
    return WordIds(tokenizer_path(vocabulary))


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, end: int = END, text: str = "text") -> DataFrame:
    """doc_id, piece (from 0), start (ids of the document before it), length, ids (unsigned 32-bit, little-endian)."""

    def cut(held: Slice) -> pa.RecordBatch:
        distinct, codes, firsts = stretches(held, words=True)
        tokens, ends = encoder(vocabulary).of(distinct.to_pylist(), codes)
        stops = ends[firsts[1:]]
        tokens = np.insert(tokens, stops, end).astype("<u4")
        totals = np.diff(np.concatenate([[0], stops])) + 1
        counts = -(-totals // window)
        owner = np.repeat(np.arange(len(totals)), counts)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = piece * window
        length = np.minimum(window, totals[owner] - start)
        offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4
        ids = pa.BinaryArray.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(offsets), pa.py_buffer(tokens.tobytes())])
        columns = [held.rows.column("doc_id").take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), ids]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])

    # the blank before a text is no token of these vocabularies, and lets every stretch begin alike
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lit(" "), F.coalesce(text, F.lit(""))).alias("text"))
    return rows.mapInArrow(mapped(cut, "text", size=SLICE_BYTES), PIECE_SCHEMA)


@dataclass
class Runs:
    """Where the pieces go: one entry per run of pieces of one length, in the order of (length, start)."""

    start: np.ndarray  # place of the run's first piece in the order by length
    length: np.ndarray
    each: np.ndarray  # pieces that a sequence takes
    sequence: np.ndarray  # the first sequence
    offset: np.ndarray  # tokens in these sequences before the run
    sequences: int


def room_score(room: np.ndarray, need: np.ndarray, capacity: Capacity, rule: str) -> np.ndarray:
    whole = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weights = np.array(capacity.weights)
    if rule == "norm":
        return (((room - need) / whole) ** 2 * weights).sum(axis=1)
    if rule == "dot":
        return ((room / whole) * (need / whole) * weights).sum(axis=1)
    raise ValueError(f"no rule {rule!r}")


def best_fit(histogram: dict[int, int], capacity: Capacity, rule: str = "norm") -> Runs:
    """Vector best-fit by falling length for a histogram {length: pieces}."""
    empty = np.array([capacity.tokens, capacity.documents, capacity.attention], np.int64)
    room, first, count = np.zeros((256, 3), np.int64), np.zeros(256, np.int64), np.zeros(256, np.int64)
    used = opened = 0
    before = dict(zip(sorted(histogram), np.cumsum([0, *(histogram[n] for n in sorted(histogram))]).tolist(), strict=False))
    runs: list[tuple[int, int, int, int, int]] = []

    def add(left: np.ndarray, start: int, n: int) -> None:
        nonlocal room, first, count, used
        if used == len(first):
            room, first, count = (np.concatenate([x, np.zeros_like(x)]) for x in (room, first, count))
        room[used], first[used], count[used] = left, start, n
        used += 1

    for length in sorted(histogram, reverse=True):
        need, left, place = needs(length), histogram[length], before[length]
        if (need > empty).any():
            raise ValueError(f"a piece of {length} tokens does not fit an empty sequence")
        while left:
            open_ = np.flatnonzero((room[:used] >= need).all(axis=1))
            if not len(open_):
                fit = int((empty // need).min())
                add(empty, opened, -(-left // fit))
                opened += int(count[used - 1])
                continue
            score = room_score(room[open_], need, capacity, rule)
            ties = open_[score == score.min()]
            at = int(ties[np.argmin(first[ties])])
            fit, start, n = int((room[at] // need).min()), int(first[at]), int(count[at])
            offset, state = capacity.tokens - int(room[at, 0]), room[at].copy()
            full = min(n, left // fit)
            if full:
                runs.append((place, length, fit, start, offset))
                place, left = place + full * fit, left - full * fit
                room[at], count[at] = state - fit * need, full
                if full < n:
                    add(state, start + full, n - full)
            else:  # fewer pieces than one sequence can take
                runs.append((place, length, left, start, offset))
                room[at], count[at] = state - left * need, 1
                if n > 1:
                    add(state, start + 1, n - 1)
                left = 0
    table = np.array(sorted(runs), np.int64).reshape(-1, 5).T
    return Runs(*table, opened)


def pack(cut: DataFrame, capacity: Capacity | None = None, rule: str = "norm") -> DataFrame:
    """Add sequence_id and offset to pieces: any frame with a column ``length``; doc_id and piece decide among equal lengths."""
    capacity = capacity or Capacity()
    kept = [c for c in cut.columns if c.lower() not in ("sequence_id", "offset")]
    keys = ["length", *(c for c in ("doc_id", "piece") if c in kept)]
    rows = cut.select(*[F.col(c) for c in keys], F.struct(*kept).alias("row"), F.monotonically_increasing_id().alias("tie"))
    rows = written(rows, "pieces")
    counts = rows.groupBy("length").agg(F.count("*").alias("n")).collect()  # a row for each length up to the window
    runs = best_fit({int(r["length"]): r["n"] for r in counts}, capacity, rule)
    placed = ranked(rows, [*keys, "tie"]).select("row", "place")

    def seated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            run = np.searchsorted(runs.start, place, "right") - 1
            within = place - runs.start[run]
            sequence = runs.sequence[run] + within // runs.each[run]
            offset = runs.offset[run] + within % runs.each[run] * runs.length[run]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sequence), pa.array(offset)], ["row", "sequence_id", "offset"])

    schema = placed.select("row").schema.add("sequence_id", "long").add("offset", "long")
    return placed.mapInArrow(seated, schema).select("row.*", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_documents, n_tokens, ids: the packed pieces' tokens end to end.

    A sequence is bounded by its capacities, so its group is small.
    """
    held = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    joined = F.aggregate("held", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    grouped = packed.groupBy("sequence_id").agg(held.alias("held"), F.count("*").alias("n_documents"), F.sum("length").alias("n_tokens"))
    return grouped.select("sequence_id", "n_documents", "n_tokens", joined.alias("ids"))
