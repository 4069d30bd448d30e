"""Words, hashes and slices of text columns, vectorised over Arrow batches.

A slice is a few megabytes of whole texts laid end to end as one byte array, so
that one numpy call works on thousands of documents. A text is never cut; a
text longer than the slice size makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
# Words are runs of anything but space, tab, LF, VT, FF and CR.
SEPARATORS = r"[\x20\x09-\x0D]+"

U64 = np.uint64
NAME_SEED = 0x5EED


def word_count(text: Column | str) -> Column:
    """Number of words; null and empty texts have none."""
    column = F.col(text) if isinstance(text, str) else text
    parts = F.size(F.split(F.regexp_replace(column, f"^{SEPARATORS}", ""), SEPARATORS))
    blank = column.isNull() | ~F.coalesce(column, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    trailing = F.when(column.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    return F.when(blank, F.lit(0)).otherwise(parts - trailing).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text: Column | str) -> Column:
    """A-Z to a-z; no other letter changes; null stays null."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Rolling:
    """Hashes of any run of symbols in constant time each, from prefix sums.

    The hash of s[a:b] is sum(value(s[i]) * base**(i-a)) modulo 2**64, where the
    symbols have random 64-bit values.
    """

    def __init__(self, seed: int):
        generator = np.random.default_rng(seed)
        self.table = generator.integers(0, 2**64, 256, dtype=U64)
        self.base = U64(int(generator.integers(0, 2**60)) * 8 + 5)
        self.inverse = U64(pow(int(self.base), -1, 2**64))
        self.powers = self.inverses = np.ones(1, U64)

    def reach(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            for name, factor in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(size, factor, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of uint64 symbol values."""
        self.reach(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.powers[: len(values)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self.reach(len(sums))
        return mix((sums[end] - sums[start]) * self.inverses[start])


WORD_HASH, SECOND_HASH = Rolling(11), Rolling(23)


class Slice:
    """Some rows of a batch with their texts as one byte array."""

    def __init__(self, rows: pa.RecordBatch, column: str, lower: bool = False):
        self.rows = rows
        texts = pc.fill_null(rows.column(column).cast(pa.large_binary()), b"")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
        self.data, self.offsets = data[bounds[0] : bounds[-1]], bounds - bounds[0]
        if lower:
            capital = (self.data >= 65) & (self.data <= 90)
            self.data = np.where(capital, self.data + 32, self.data).astype(np.uint8)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every word, and the first word of every row."""
        data = self.data
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        first = np.zeros(len(data) + 1, bool)
        first[self.offsets] = True
        inner = np.empty(len(data), bool)  # whether the byte before belongs to the same text and word
        inner[:1] = False
        inner[1:] = ~blank[:-1]
        inner &= ~first[:-1]
        starts = np.flatnonzero(~blank & ~inner)
        last = np.empty(len(data), bool)
        last[:-1] = blank[1:] | first[1:-1]
        last[-1:] = True
        ends = np.flatnonzero(~blank & last) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash per word, and the first word of every row."""
        starts, ends, bounds = self.words()
        return WORD_HASH.of(WORD_HASH.sums(WORD_HASH.table[self.data]), starts, ends), bounds


    def word_names(self) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit name per word, hashed from its bytes once per distinct word, and the first word of every row.

        Unlike sums of powers, this hash has no pairs of words that are sure to meet.
        """
        starts, ends, bounds = self.words()
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        blank = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        held = pa.py_buffer(np.ascontiguousarray(self.data[~blank]))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), held]).dictionary_encode()
        names = np.fromiter((xxhash.xxh3_64_intdigest(w, NAME_SEED) for w in words.dictionary.to_pylist()), U64, len(words.dictionary))
        return names[words.indices.to_numpy(zero_copy_only=False)], bounds


def slices(batches: Iterator[pa.RecordBatch], column: str, lower: bool = False, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut Arrow batches into slices of at most ``size`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(lengths, dtype=np.int64), 0
        while start < batch.num_rows:
            used = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, used + size, "right")))
            yield Slice(batch.slice(start, end - start), column, lower)
            start = end


def owners(bounds: np.ndarray) -> np.ndarray:
    """Row of each word, given the first word of every row."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def mapped(work: Callable[[Slice], pa.RecordBatch | None], column: str, lower: bool = False, size: int = SLICE_BYTES):
    """A function for ``mapInArrow`` that handles one slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, column, lower, size):
            made = work(piece)
            if made is not None and made.num_rows:
                yield made

    return run
