"""Toxic passages as maximum-scoring segments of token log-odds.

Every word gets the log-odds of toxic against clean text, estimated with
Dirichlet priors in two steps: the background rate of the word's opening bytes, over
all documents, is the prior of the opening's rate in either class, and the opening's rates are the
prior of the word's. A word never seen in the labelled sample is thus judged by
its opening, and a word seen nowhere is neutral. A constant is subtracted, so that clean text drifts
downwards, and one linear scan with a stack finds all maximal segments: runs of words
that score positive as a whole and cannot be extended without loss. Segments
are the passages.

Extreme-value calibration: the best segment of clean text of n words follows
a Gumbel law with location log(K n) / lambda. Both constants are
estimated from the clean labelled documents; a segment of score S has the E-value
K n exp(-lambda S). A document's evidence sums the excess of its segments over
chance, and a logistic curve through the labelled sample turns it into the score.

The word tables are arrays of fixed size, indexed by hash (``WORD_BITS``, ``OPENING_BITS``); they are
all that is sent to the tasks. Fitting takes the ``FIT_PER_CLASS`` labelled
documents of each class with the smallest hash of their id; background counts cover all documents.

Words are compared in lower case (A-Z) without marks at their ends. Null and empty texts have no segment and get
the score of documents without any. Repeated rows get equal scores; a document with several label rows
counts once, with the largest label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vibralake.llm.quality import labelled_sample
from vibralake.llm.texts import U64, WORD_HASH, Slice, mapped, mix, owners, slices

WORD_BITS = 20
OPENING_BITS = 16
OPENING_BYTES = 4
FIT_PER_CLASS = 3000
BACKGROUND = 0.05  # prior tokens of an opening per background token
OPENING_PRIOR = 2.0  # and for every opening, whatever its background
WORD_PRIOR = 10.0  # prior tokens of a word, shared out as its opening's
DRIFT = 2.0


def tokens(piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Table slot of every word and of its opening, first word of every row, start and end byte."""
    starts, ends, bounds = piece.words()
    data = piece.data
    mark = (data < 48) | ((data > 57) & (data < 65)) | ((data > 90) & (data < 97)) | ((data > 122) & (data < 128))
    if len(starts):
        # the first and last byte of a word that is no mark; a word of marks keeps its bytes
        plain = np.flatnonzero(~mark)
        if len(plain):
            a = plain[np.minimum(np.searchsorted(plain, starts), len(plain) - 1)]
            b = plain[np.maximum(np.searchsorted(plain, ends) - 1, 0)] + 1
            has = (a >= starts) & (a < ends)
            left, right = np.where(has, a, starts), np.where(has, b, ends)
        else:
            left, right = starts, ends
    else:
        left, right = starts, ends
    sums = WORD_HASH.sums(WORD_HASH.table[data])
    word = WORD_HASH.of(sums, left, right)
    opening = mix(WORD_HASH.of(sums, left, np.minimum(left + OPENING_BYTES, right)) + U64(1))
    shift = U64(64 - WORD_BITS), U64(64 - OPENING_BITS)
    return (word >> shift[0]).astype(np.int64), (opening >> shift[1]).astype(np.int64), bounds, left, right


def background(docs: DataFrame) -> np.ndarray:
    """Openings in all documents, by slot: at most 2**OPENING_BITS sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << OPENING_BITS, np.int64)
        for piece in slices(batches, "text", lower=True):
            total += np.bincount(tokens(piece)[1], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])

    made = docs.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << OPENING_BITS)
    out[made["slot"].to_numpy()] = made["n"].to_numpy()
    return out


def label_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words and openings by label (column) in the labelled sample: tables of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, openings = np.zeros((1 << WORD_BITS, 2), np.int64), np.zeros((1 << OPENING_BITS, 2), np.int64)
        for piece in slices(batches, "text", lower=True):
            word, opening, bounds, _, _ = tokens(piece)
            label = piece.rows.column("label").to_numpy()[owners(bounds)]
            for table, slot in ((words, word), (openings, opening)):
                for k in (0, 1):
                    table[:, k] += np.bincount(slot[label == k], minlength=len(table))
        for kind, table in enumerate((words, openings)):
            used = np.flatnonzero(table.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), kind, np.int32)), pa.array(used), pa.array(table[used, 0]), pa.array(table[used, 1])],
                ["kind", "slot", "clean", "toxic"],
            )

    made = texts.select("text", "label").mapInArrow(count, "kind int, slot long, clean long, toxic long")
    sums = made.groupBy("kind", "slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    kind, slot = sums["kind"].to_numpy(), sums["slot"].to_numpy()
    both = np.stack([sums["clean"].to_numpy(), sums["toxic"].to_numpy()], axis=1).astype(float)
    words, openings = np.zeros((1 << WORD_BITS, 2)), np.zeros((1 << OPENING_BITS, 2))
    words[slot[kind == 0]], openings[slot[kind == 1]] = both[kind == 0], both[kind == 1]
    return words, openings


@dataclass
class Model:
    """Toxic share by opening, token counts by word, and the calibration."""

    opening: np.ndarray
    word: np.ndarray  # tokens of clean and toxic text, at equal class sizes
    scale: float = 1.0  # lambda of the extreme-value law
    size: float = 1.0  # K
    slope: float = 1.0
    offset: float = 0.0


def word_scores(model: Model, word: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """Log ratio of the posterior mean rates, less the drift."""
    toxic = model.opening[opening]
    seen = model.word[word]
    return np.log(seen[:, 1] + WORD_PRIOR * toxic) - np.log(seen[:, 0] + WORD_PRIOR * (1 - toxic)) - DRIFT


def segments(scores: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All maximal scoring segments of every row: row, first word, end word, score.

    The scan keeps a stack of candidate segments with the running sums left and right of each. A new positive word joins
    the nearest candidate with a smaller left sum if that makes a better whole, else it
    stands alone. Each candidate knows that nearest one, so a search passes a candidate by once at most, and a row takes time in
    proportion to its positive words.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    positive = np.flatnonzero(scores > 0)
    rows = np.searchsorted(bounds, positive, "right") - 1
    out: list[tuple[int, int, int, float]] = []
    stack: list[tuple[int, int, float, float, int]] = []  # first word, end word, sum before, sum at the end, nearest with a smaller sum before
    current = -1

    def flush() -> None:
        out.extend((current, s[0], s[1], s[3] - s[2]) for s in stack)
        stack.clear()

    for row, at, left, right in zip(rows.tolist(), positive.tolist(), sums[positive].tolist(), sums[positive + 1].tolist(), strict=True):
        if row != current:
            flush()
            current = row
        first, near = at, len(stack) - 1
        while True:
            while near >= 0 and stack[near][2] >= left:
                near = stack[near][4]
            if near < 0 or stack[near][3] >= right:
                stack.append((first, at + 1, left, right, near))
                break
            first, _, left, _, before = stack[near]
            del stack[near:]
            near = before
    flush()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, c, d = zip(*out, strict=True)
    return np.array(a), np.array(b), np.array(c), np.array(d)


def row_evidence(model: Model, rows: np.ndarray, score: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Per row, the sum over segments of the part of -log(E-value) above zero."""
    e = model.scale * score - np.log(model.size * np.maximum(n_words[rows], 1))
    return np.bincount(rows, np.maximum(e, 0), minlength=len(n_words))


def best_segments(texts: DataFrame, model: Model) -> DataFrame:
    """doc_id, label, n_words, best and the scores of all segments of labelled texts."""

    def found(piece: Slice) -> pa.RecordBatch:
        word, opening, bounds, _, _ = tokens(piece)
        rows, _, _, score = segments(word_scores(model, word, opening), bounds)
        order = np.searchsorted(rows, np.arange(len(bounds)))
        held = [score[a:b].tolist() for a, b in zip(order[:-1], order[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [piece.rows.column("doc_id"), piece.rows.column("label"), pa.array(np.diff(bounds)), pa.array(held, pa.list_(pa.float64()))],
            ["doc_id", "label", "n_words", "scores"],
        )

    return texts.mapInArrow(mapped(found, "text", lower=True), "doc_id long, label int, n_words long, scores array<double>")


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, per_class: int = FIT_PER_CLASS) -> Model | None:
    """Fit on a bounded sample of labelled documents; None where a class is missing."""
    sample, counts = labelled_sample(labels, "toxic", folds, held, per_class)
    if len(counts) < 2:
        return None
    sample = sample.withColumnRenamed("doc_id", "_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    texts = texts.select("doc_id", "text", "label")
    words, openings = label_counts(texts)
    total = openings.sum(axis=0)
    if not total.all():
        return None
    base = background(docs)
    even = total.mean() / total  # counts as if both classes had as many tokens
    prior = OPENING_PRIOR + BACKGROUND * total.mean() * base / max(base.sum(), 1.0)
    rates = openings * even + prior[:, None]
    share = rates[:, 1] / rates.sum(axis=1)
    model = Model(share.astype(np.float32), (words * even).astype(np.float32))
    rows = best_segments(texts, model).dropDuplicates(["doc_id"]).collect()  # at most 2 * per_class documents
    return calibrated(model, sorted(rows, key=lambda r: r.doc_id), counts)


def calibrated(model: Model, rows: list, counts: dict[int, int]) -> Model | None:
    """Extreme-value constants from clean documents, then a logistic curve over the evidence."""
    label = np.array([r.label for r in rows], float)
    if not 0 < label.sum() < len(label):
        return None
    n = np.array([r.n_words for r in rows], np.int64)
    best = np.array([max(r.scores, default=0.0) for r in rows])
    clean = (label == 0) & (n > 0)
    level, size = best[clean], np.log(np.maximum(n[clean], 1))
    # moments of the Gumbel law: the variance gives lambda, the mean gives K
    spread = max(float(level.std()), 0.25)
    model.scale = np.pi / (spread * np.sqrt(6))
    model.size = float(np.exp(np.mean(model.scale * level - 0.5772 - size))) if len(level) else 1.0
    held = np.repeat(np.arange(len(rows)), [len(r.scores) for r in rows])
    score = np.array([s for r in rows for s in r.scores])
    x = np.log1p(row_evidence(model, held, score, n))
    share = counts[1] / (counts[0] + counts[1])
    weight = np.where(label == 1, share / label.sum(), (1 - share) / (1 - label).sum())
    slope, offset = 1.0, -1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        g = np.array([((p - label) * x * weight).sum() + 1e-3 * slope, ((p - label) * weight).sum()])
        w = weight * p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.offset = float(slope), float(offset)
    return model


def passages(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, and its significant passages.

    A passage (first_word, end_word, score, e_value) has an E-value below 0.01. Without a model
    every score is 0 and nothing is significant.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "array<struct<first_word:long,end_word:long,score:double,e_value:double>>"
    if model is None:
        return plain.select("doc_id", F.lit(0.0).alias("score"), F.array().cast(kind).alias("passages"))
    fields = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def scored(piece: Slice) -> pa.RecordBatch:
        word, opening, bounds, _, _ = tokens(piece)
        rows, first, end, score = segments(word_scores(model, word, opening), bounds)
        n = np.diff(bounds)
        x = np.log1p(row_evidence(model, rows, score, n))
        value = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))
        e = np.exp(np.clip(np.log(model.size * np.maximum(n[rows], 1)) - model.scale * score, -700, 700))
        held: list[list[dict]] = [[] for _ in n]
        for k in np.flatnonzero(e < 0.01):
            start = int(bounds[rows[k]])
            held[rows[k]].append({"first_word": int(first[k]) - start, "end_word": int(end[k]) - start, "score": float(score[k]), "e_value": float(e[k])})
        return pa.RecordBatch.from_arrays([piece.rows.column("doc_id"), pa.array(value), pa.array(held, fields)], ["doc_id", "score", "passages"])

    return plain.mapInArrow(mapped(scored, "text", lower=True), f"doc_id long, score double, passages {kind}")
