"""Alignment of two tokenizers' ids over whole texts.

Tokenizer A is byte-level and sees a blank before the text; tokenizer B adds one itself. After a text is tokenised in full by both, the places where
tokens of both end are compared by their bytes. Such a shared end before a token that begins with a blank, in A and in B, or where a text is
cut to be tokenised, is an anchor; anchors split the text into windows of token ids. A window's groups (cut at all its shared ends) depend on its
ids alone, so windows are numbered by their pair of id tuples and each number of a block is aligned once, all of a block at a time. Stretches of
text whose ids a worker remembers are not tokenised again.

Links are the A-B token occurrences that share a group. The count of a pair of ids is the number of documents that hold it linked.

The work is dealt in blocks of some megabytes of text. A block keeps its windows once, its texts as window numbers, and its distinct pairs
with the number of its documents that hold them; only these pairs travel, once a block, to be summed and to find the best partners of
an A id. The sums come back to the blocks, where links are counted by window. So a pair that all documents hold is
a row per block, and no row per document and pair is ever made.

Defined results: texts that are null, empty, or whose A or B bytes joined are not the blank and the text have no tokens: zeros and an empty
``groups``. Rows that repeat an id, or have none, are documents of their own, in results and in counts. Columns other than the id and the text are not read. A text
has to fit a worker's memory, with some sixty bytes a token. Group sizes are not limited: a group's links are kept as distinct
pairs with how often each occurs.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vibralake.llm.texts import Slice, slices
from vibralake.llm.token_pieces import REMEMBERED, gathered, stretches, tokenizer_path
from vibralake.session import fits, scratch_dir, written

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
BLOCK_BYTES = 1 << 20
BLANK = 32
# A blank and letters of one or two bytes, up to U+024F: one piece to A's merges.
WORD = re.compile(rb" (?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]|[\xC4-\xC9][\x80-\xBF])+")
# In a piece of B: an ASCII mark behind a letter, or a line's end. Where there is none, texts are cut before such marks too.
REACHING = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F][!-/:-@\[-`{-~]|\n")
# Stretches that are tokenised at a time, and blocks of a row group.
AT_ONCE = 2_000
GROUP_ROWS = 4
# Pairs, of 16 bytes each, that are sent to every task.
FEW_PAIRS = 2_000_000

BLOCK_SCHEMA = (
    "block long, doc_id array<long>, windows array<int>, sequence binary, sizes binary, texts binary, text_sizes binary,"
    " link_pair binary, link_times binary, links binary, pairs array<long>, documents array<int>"
)
ALIGNED_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Visible Latin-1 characters stand for themselves, the other bytes are numbered from 256 on.
    """
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Spelling:
    """What every id of a vocabulary stands for: its bytes and its decimal digits, each laid end to end."""

    def __init__(self, parts: list[bytes]):
        self.size = np.array([len(x) for x in parts], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join(parts) + b"\0", np.uint8)
        digits = [str(i).encode() for i in range(len(parts))]
        self.digit_bounds = np.concatenate([[0], np.cumsum([len(x) for x in digits])])
        self.digits = np.frombuffer(b"".join(digits), np.uint8)


class Aligner:
    """Both tokenizers, and the ids of stretches that a worker remembers."""

    def __init__(self, vocabulary_a: str, vocabulary_b: str):
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(tokenizer_path(vocabulary_a))
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.merges = Tokenizer(self.a.model)
        self.merges.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(vocabulary_b))
        symbols = byte_symbols()
        self.symbols = "".join(" " if b == 0 else c for b, c in sorted((b, c) for c, b in symbols.items()))
        names = sorted((i, t) for t, i in self.a.get_vocab().items())
        self.of_a = Spelling([bytes(symbols[c] for c in t) if all(c in symbols for c in t) else b"" for _, t in names])
        pieces = range(self.b.get_piece_size())
        self.of_b = Spelling([self.piece_bytes(i) for i in pieces])
        named = (i for i in pieces if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))
        self.marks = not any(REACHING.search(self.b.id_to_piece(i)) for i in named)
        self.start()

    def piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def start(self) -> None:
        """Forget all stretches."""
        self.known: dict[bytes, int] = {}
        self.ids, self.bounds = [array("i", [0]), array("i", [0])], [array("q", [1]), array("q", [1])]

    def learn(self, keys: list[bytes], a: np.ndarray, ends_a: np.ndarray) -> None:
        """Remember stretches whose ids by A are given, and encode them by B."""
        # B adds a blank, but not to an empty text; at the end of a text the blank is a piece of its own. A stretch without a blank goes behind
        # a line's end, which B never joins to anything: the added blank and that end are the first two ids
        texts = [k[1:].decode("utf-8", "replace") if k[0] == BLANK else "\n" + k.decode("utf-8", "replace") for k in keys]
        found = self.b.encode(texts, num_threads=1) if keys else []
        found = [ids if k[0] == BLANK and len(k) > 1 else ids[2:] or [self.b.piece_to_id("▁")] for k, ids in zip(keys, found, strict=True)]
        ends_b = np.cumsum([len(x) for x in found], dtype=np.int64)
        b = np.fromiter(chain.from_iterable(found), np.int32, int(ends_b[-1]) if found else 0)
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys)), strict=True))
        for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
            self.bounds[side].frombytes((ends + len(self.ids[side])).astype(np.int64).tobytes())
            self.ids[side].frombytes(ids.astype(np.int32).tobytes())

    def of(self, keys: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B the ids of the stretches end to end, and where each stretch begins.

        A blank and letters are one piece to A's merges; many such words are taken at a time. Other stretches go A's full way.
        """
        if len(self.known) > REMEMBERED:
            self.start()
        plain, other = [], []
        for k in dict.fromkeys(keys):
            if k not in self.known:
                (plain if WORD.fullmatch(k) else other).append(k)
        for at in range(0, len(plain), AT_ONCE):
            part = plain[at : at + AT_ONCE]
            words = b"\0".join(part).decode("latin-1").translate(self.symbols)
            ids = np.array(self.merges.encode_batch_fast([words], add_special_tokens=False)[0].ids)
            # the merges lose no byte
            self.learn(part, ids, np.searchsorted(np.cumsum(self.of_a.size[ids]), np.cumsum([len(k) for k in part])) + 1)
        for at in range(0, len(other), AT_ONCE):
            part = other[at : at + AT_ONCE]
            found = [x.ids for x in self.a.encode_batch_fast([k.decode("utf-8", "replace") for k in part], add_special_tokens=False)]
            ends = np.cumsum([len(x) for x in found], dtype=np.int64)
            self.learn(part, np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1])), ends)
        place = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        return [gathered(np.frombuffer(f, np.int32), np.frombuffer(b, np.int64), place) for f, b in zip(self.ids, self.bounds, strict=True)]


@cache
def aligner(vocabulary_a: str, vocabulary_b: str) -> Aligner:
    return Aligner(vocabulary_a, vocabulary_b)


def agreeing(ids: np.ndarray, starts: np.ndarray, spelling: Spelling, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether the bytes of each stretch's ids are the stretch."""
    size = spelling.size[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    fine = ends[starts[1:]] - ends[starts[:-1]] == np.diff(bounds)
    kept = np.repeat(fine, np.diff(starts))
    spelled, _ = gathered(spelling.bytes, spelling.bounds, ids[kept])
    wanted, edges = gathered(data, bounds, np.flatnonzero(fine))
    wrong = np.concatenate([[0], np.cumsum(spelled != wanted)])
    fine[fine] = wrong[edges[1:]] == wrong[edges[:-1]]
    return fine


def distinct_of(values: np.ndarray) -> np.ndarray:
    """Distinct integers in ascending order, by sorting."""
    ordered = np.sort(values)
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    return ordered[fresh]


class Windows:
    """The windows of some stretches, each pair of id tuples once, with its groups.

    ``first``: the first window of every stretch, among ``codes``; ``codes``: the number of each window by its ids. Of each number:
    ``sizes`` (A tokens, B tokens, groups, links), its groups as text, closed by a semicolon, and its distinct links with how often each occurs.
    """

    def __init__(self, both: Aligner, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], data: np.ndarray, bounds: np.ndarray):
        (ids_a, starts_a), (ids_b, starts_b) = a, b
        # every stretch's bytes agree, so ends count bytes from the first stretch on, for A and B alike
        end_a, end_b = np.cumsum(both.of_a.size[ids_a]), np.cumsum(both.of_b.size[ids_b])
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        marked = np.isin(shared, bounds[1:], assume_unique=True)
        marked |= data[np.minimum(shared, len(data) - 1)] == BLANK
        window = np.cumsum(marked) - marked  # of each group
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        n = int(marked.sum())
        ends = shared[marked]
        self.first = np.searchsorted(ends, bounds, "right")
        window_a, window_b = window[group_a], window[group_b]

        # the ids of a window as bytes: A's, a mark, B's
        n_a, n_b = np.bincount(window_a, minlength=n), np.bincount(window_b, minlength=n)
        offsets = np.concatenate([[0], np.cumsum(n_a + n_b + 1)])
        keys = np.full(offsets[-1], -1, np.int32)
        at_a, at_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        keys[offsets[window_a] + np.arange(len(ids_a)) - at_a[window_a]] = ids_a
        keys[offsets[window_b] + n_a[window_b] + 1 + np.arange(len(ids_b)) - at_b[window_b]] = ids_b
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets * 4), pa.py_buffer(keys)])
        self.codes = held.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # the window of each number that comes first stands for all: only its groups are worked out
        number, chosen = np.unique(self.codes, return_index=True)
        self.n = len(number)
        of = np.full(n, -1)
        of[chosen] = number
        kept_a, kept_b, kept = of[window_a] >= 0, of[window_b] >= 0, of[window] >= 0
        order = np.argsort(of[window[kept]], kind="stable")  # groups by number
        group = np.full(len(shared), -1)
        group[np.flatnonzero(kept)[order]] = np.arange(len(order))
        self._lay(both, ids_a[kept_a], group[group_a[kept_a]], ids_b[kept_b], group[group_b[kept_b]], of[window[kept]][order])

    def _lay(self, both: Aligner, ids_a: np.ndarray, group_a: np.ndarray, ids_b: np.ndarray, group_b: np.ndarray, number: np.ndarray) -> None:
        """Texts, sizes and links from the tokens of each group and the number that each group belongs to, which ascends."""
        groups = len(number)
        order_a, order_b = np.argsort(group_a, kind="stable"), np.argsort(group_b, kind="stable")
        ids_a, group_a, ids_b, group_b = ids_a[order_a], group_a[order_a], ids_b[order_b], group_b[order_b]
        n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        sums = [np.bincount(number, x, minlength=self.n).astype(np.int64) for x in (n_a, n_b, np.ones(groups), n_a * n_b)]
        self.sizes = np.stack(sums, axis=1).reshape(-1, 4)

        # text: the digits of A's ids of a group, then B's; behind each a comma, a bar or a semicolon
        before_a, before_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        place_a = np.arange(len(ids_a)) + before_b[group_a]
        place_b = np.arange(len(ids_b)) + before_a[group_b + 1]
        total = len(ids_a) + len(ids_b)
        size, mark = np.empty(total, np.int64), np.empty(total, np.uint8)
        for ids, place, group, before, spelling, last in ((ids_a, place_a, group_a, before_a, both.of_a, b"|"), (ids_b, place_b, group_b, before_b, both.of_b, b";")):
            size[place] = np.diff(spelling.digit_bounds)[ids]
            mark[place] = np.where(np.arange(len(ids)) + 1 == before[group + 1], last[0], ord(","))
        ends = np.cumsum(size + 1)
        out = np.empty(int(ends[-1]) if total else 0, np.uint8)
        out[ends - 1] = mark
        for ids, place, spelling in ((ids_a, place_a, both.of_a), (ids_b, place_b, both.of_b)):
            digits, runs = gathered(spelling.digits, spelling.digit_bounds, ids)
            out[np.repeat(ends[place] - 1 - size[place] - runs[:-1], size[place]) + np.arange(len(digits))] = digits
        self.texts = out
        tokens = np.concatenate([[0], np.cumsum(self.sizes[:, 0] + self.sizes[:, 1])])
        self.text_bounds = np.concatenate([[0], ends])[tokens]

        # links: distinct ids of A times distinct ids of B in each group
        width_a, width_b = len(both.of_a.size), len(both.of_b.size)
        once_a, times_a = np.unique(group_a * width_a + ids_a, return_counts=True)
        once_b, times_b = np.unique(group_b * width_b + ids_b, return_counts=True)
        of_a, of_b = once_a // width_a, once_b // width_b
        start_b = np.searchsorted(of_b, np.arange(groups + 1))
        other, runs = gathered(np.arange(len(once_b)), start_b, of_a)
        mine = np.repeat(np.arange(len(once_a)), np.diff(runs))
        self.pairs, pair = np.unique((once_a[mine] % width_a) << 32 | once_b[other] % width_b, return_inverse=True)
        key = number[of_a[mine]] * max(1, len(self.pairs)) + pair
        once, where = np.unique(key, return_inverse=True)
        self.link_times = np.bincount(where, times_a[mine] * times_b[other], minlength=len(once)).astype(np.int64)
        held, self.link_pair = np.divmod(once, max(1, len(self.pairs)))
        self.link_bounds = np.searchsorted(held, np.arange(self.n + 1))


def short(numbers: np.ndarray) -> bytes:
    """32-bit integers; a window's numbers are bounded by its text, which a block holds."""
    return numbers.astype(np.int32).tobytes()


def block_of(held: Slice, number: int, both: Aligner) -> dict:
    """One block's row from the texts of a slice."""
    distinct, codes, firsts = stretches(held, marks=both.marks)
    a, b = both.of(distinct.to_pylist())
    bounds = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    data = np.frombuffer(distinct.buffers()[2], np.uint8) if len(distinct) else np.zeros(1, np.uint8)
    good = agreeing(*a, both.of_a, data, bounds) & agreeing(*b, both.of_b, data, bounds)
    wrong = np.concatenate([[0], np.cumsum(~good[codes])])
    fine = wrong[firsts[1:]] == wrong[firsts[:-1]]  # documents whose bytes agree throughout
    codes = codes[np.repeat(fine, np.diff(firsts))]
    firsts = np.concatenate([[0], np.cumsum(np.where(fine, np.diff(firsts), 0))])

    chosen = np.flatnonzero(good)
    (ids_a, starts_a), (ids_b, starts_b) = (gathered(ids, starts, chosen) for ids, starts in (a, b))
    data, bounds = gathered(data, bounds, chosen)
    found = Windows(both, (ids_a, starts_a), (ids_b, starts_b), data, bounds)
    row = np.cumsum(good) - 1  # of a stretch among the agreeing ones
    sequence, ends = gathered(found.codes, found.first, row[codes])
    windows = ends[firsts]

    # documents that hold each pair: windows once a document, then pairs once a document
    n, pairs = max(1, found.n), max(1, len(found.pairs))
    owner = np.repeat(np.arange(len(windows) - 1), np.diff(windows))
    doc, window = np.divmod(distinct_of(owner * n + sequence), n)
    met, ends = gathered(found.link_pair, found.link_bounds, window)
    met = distinct_of(np.repeat(doc, np.diff(ends)) * pairs + met)
    documents = np.bincount(met % pairs, minlength=len(found.pairs))
    there = documents > 0  # a stretch may be of documents without tokens only
    link = there[found.link_pair]
    return {
        "block": number, "doc_id": held.rows.column("doc_id").to_pylist(), "windows": windows.astype(np.int32), "sequence": short(sequence),
        "sizes": short(found.sizes), "texts": found.texts.tobytes(), "text_sizes": short(np.diff(found.text_bounds)),
        "link_pair": short(np.where(link, (np.cumsum(there) - 1)[found.link_pair], 0)),
        "link_times": short(np.where(link, found.link_times, 0)), "links": short(np.diff(found.link_bounds)),
        "pairs": found.pairs[there], "documents": documents[there].astype(np.int32),
    }


def blocks(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B, text: str = "text") -> DataFrame:
    """The block table, written to the shared folder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = aligner(vocabulary_a, vocabulary_b), TaskContext.get().partitionId() << 32
        for held in slices(batches, "text", size=BLOCK_BYTES):
            row = block_of(held, number, both)
            number += 1
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 7, pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.when(F.length(text) > 0, F.concat(F.lit(" "), F.col(text))).alias("text")
    )
    # blocks are long rows: small row groups, so that a writing task holds few of them
    path = scratch_dir(docs.sparkSession, "token_blocks")
    small = {"parquet.block.row.count.limit": GROUP_ROWS, "compression": "zstd"}
    rows.mapInArrow(cut, BLOCK_SCHEMA).write.options(**small).parquet(path)
    return docs.sparkSession.read.schema(BLOCK_SCHEMA).parquet(path)


def pair_rows(held: DataFrame) -> DataFrame:
    """block, place, pair, documents: the distinct pairs of each block."""
    zipped = F.posexplode(F.arrays_zip("pairs", "documents")).alias("place", "x")
    return held.select("block", zipped).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.documents").alias("documents"))


def pair_counts(held: DataFrame) -> DataFrame:
    """a_id, b_id, documents, best: how many documents hold each pair linked, and whether its A id has no higher count."""
    counts = pair_rows(held).groupBy("pair").agg(F.sum("documents").alias("documents"))
    counts = written(counts.withColumn("a_id", F.shiftright("pair", 32)), "pair_counts")
    top = counts.groupBy("a_id").agg(F.max("documents").alias("top"))  # an A id has at most as many partners as B has ids
    known = counts.join(top, "a_id")
    return known.select("a_id", F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"), "documents", (F.col("documents") == F.col("top")).alias("best"))


ALIGNED_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def counted(row: dict, known: np.ndarray) -> pa.RecordBatch:
    """The documents of a block; ``known`` has 2 * documents + best of each of its pairs."""
    numbers = {n: np.frombuffer(row[n].as_py(), np.int32).astype(np.int64) for n in ("sequence", "sizes", "text_sizes", "link_pair", "link_times", "links")}
    pair, times = numbers["link_pair"], numbers["link_times"]
    sizes = numbers["sizes"].reshape(-1, 4)
    stats = np.zeros((len(sizes), 6), np.int64)
    stats[:, :4] = sizes
    if len(known):  # every window has links
        starts = np.cumsum(numbers["links"]) - numbers["links"]
        stats[:, 4] = np.add.reduceat(times * (known[pair] & 1), starts)
        stats[:, 5] = np.add.reduceat(times * (known[pair] >> 1), starts)
    sequence, windows = numbers["sequence"], row["windows"].values.to_numpy()
    sums = np.zeros((len(sequence) + 1, 6), np.int64)
    np.cumsum(stats[sequence], axis=0, out=sums[1:])
    each = sums[windows[1:]] - sums[windows[:-1]]
    whole, ends = row["texts"].as_py(), np.cumsum(numbers["text_sizes"]).tolist()
    texts = [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    order, bounds = sequence.tolist(), windows.tolist()
    groups = [b"".join([texts[c] for c in order[a:b]])[:-1] for a, b in zip(bounds, bounds[1:], strict=False)]  # less the last semicolon
    columns = [row["doc_id"].values, *(pa.array(each[:, k]) for k in range(6)), pa.array(groups, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ALIGNED_NAMES)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i] for name in batch.schema.names}


def align(held: DataFrame, known: DataFrame, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """One row per document of the blocks: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``known`` has the pair counts. ``groups`` is text: A ids, a bar and B ids of each group, groups apart by semicolons. Up to
    ``few_pairs`` pairs, counted first, are sent to the tasks that read the blocks; more go to the blocks that hold them by a join.
    """
    pair = F.shiftleft("a_id", 32).bitwiseOR(F.col("b_id")).alias("pair")
    valued = known.select(pair, (F.col("documents") * 2 + F.col("best").cast("long")).alias("value"))
    columns = held.drop("documents")
    if fits(valued, few_pairs):
        table = valued.toArrow().sort_by("pair")
        shared = held.sparkSession.sparkContext.broadcast([table[c].to_numpy() for c in ("pair", "value")])

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs, values = shared.value
            for row in rows_of(batches):
                yield counted(row, values[np.searchsorted(pairs, row["pairs"].values.to_numpy())])

        return columns.mapInArrow(whole, ALIGNED_SCHEMA)

    lookups = pair_rows(held).select("block", "place", "pair").join(valued, "pair")
    found = lookups.groupBy("block").agg(F.collect_list(F.struct("place", "value")).alias("found"))  # bounded by the block's text

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            values = np.zeros(len(row["pairs"]), np.int64)
            if len(values):
                values[row["found"].values.field("place").to_numpy()] = row["found"].values.field("value").to_numpy()
            yield counted(row, values)

    return columns.join(found, "block", "left").mapInArrow(joined, ALIGNED_SCHEMA)
