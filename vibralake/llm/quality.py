"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded: shares
of kinds of bytes, word and punctuation shapes, repetition inside the passage, all
computed for whole slices at once, then standardised and sent through one tanh
layer. Gated attention weighs the passages of a bag, softmax(w . (tanh(V h) * sigmoid(U h))),
and a logistic unit scores the weighted mean. Only the documents' labels are
used in fitting; which passages matter is learned with the attention.

The model is fitted on at most ``FIT_PER_CLASS`` labelled documents per class, those with
the smallest hash of their id, weighted so that a class counts by its share of all
labelled documents. Ids of the sample are at most twice this number, so they may be broadcast. Scoring
is one pass over the texts with the fitted arrays, a few kilobytes.

Null and empty texts are a bag of one passage without words and get its score. Repeated rows get equal
scores. A document with several label rows counts once, with the largest
label; null labels do not count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vibralake.llm.texts import Slice, mapped, owners

PASSAGE = 64
FIT_PER_CLASS = 1000
HIDDEN = 16
ATTENTION = 8
STEPS = 250
SEED = 7
FEATURES = 20


def passages(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage and the first passage of every row.

    Every row has a passage; those of rows without words are all zero but for the constant.
    """
    starts, ends, bounds = piece.words()
    words = np.diff(bounds)
    held = np.maximum(1, -(-words // PASSAGE))
    first = np.concatenate([[0], np.cumsum(held)])
    n, rows = first[-1], owners(first)
    inside = np.arange(n) - first[:-1][rows]
    left = np.minimum(bounds[:-1][rows] + inside * PASSAGE, bounds[1:][rows])
    right = np.minimum(left + PASSAGE, bounds[1:][rows])
    count = (right - left).astype(float)

    data, size = piece.data, len(piece.data)
    a = np.where(count > 0, np.append(starts, size)[left], 0)
    b = np.where(count > 0, np.append(0, ends)[right], 0)

    def between(mask: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (sums[high] - sums[low]).astype(float)

    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    digit = (data >= 48) & (data <= 57)
    high = data >= 128
    dot = (data == 46) | (data == 44)
    mark = ~(upper | lower | digit | high | dot | (data <= 32))
    kinds = [between(k, a, b) for k in (upper, lower, digit, high, dot, mark, data == 10, data == 33, data == 124)]
    length = np.maximum(b - a, 1.0)

    hashes, _ = piece.word_hashes()
    wide = (ends - starts).astype(float)
    wide2 = np.concatenate([[0], np.cumsum(wide)])
    square = np.concatenate([[0], np.cumsum(wide * wide)])
    mean = (wide2[right] - wide2[left]) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum((square[right] - square[left]) / np.maximum(count, 1) - mean**2, 0))
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    passage_of = np.repeat(np.arange(n), (right - left))
    order = np.lexsort((hashes, passage_of))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage_of[order][1:] != passage_of[order][:-1])
    distinct = np.bincount(passage_of[order][fresh], minlength=n).astype(float)
    ending = data[np.maximum(ends, 1) - 1] if len(ends) else np.zeros(0, np.uint8)
    opening = data[starts] if len(starts) else np.zeros(0, np.uint8)
    plain_end = ((ending >= 97) & (ending <= 122)) | (ending >= 128)
    capital = (opening >= 65) & (opening <= 90)
    short = wide <= 2

    def per_word(mask: np.ndarray) -> np.ndarray:
        return between(mask, left, right) / np.maximum(count, 1)

    columns = [k / length for k in kinds] + [
        mean, spread, distinct / np.maximum(count, 1), per_word(same), per_word(plain_end), per_word(capital), per_word(short),
        np.log1p(count), np.log1p(held[rows]), per_word(wide >= 14), (count == 0).astype(float),
    ]
    return np.stack(columns, axis=1), first


@dataclass
class Model:
    """Arrays of a fitted model; see ``forward``."""

    centre: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    tanh: np.ndarray
    gate: np.ndarray
    attend: np.ndarray
    out: np.ndarray


def encoded(model: Model, features: np.ndarray) -> np.ndarray:
    plain = np.clip((features - model.centre) / model.scale, -8, 8)
    return np.hstack([plain, np.ones((len(plain), 1))])


def forward(model: Model, inputs: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Hidden layer, attention weights and score of every bag."""
    rows = owners(first)
    h = np.tanh(inputs @ model.encode)
    t, g = np.tanh(h @ model.tanh), 1 / (1 + np.exp(-(h @ model.gate)))
    raw = (t * g) @ model.attend
    top = np.maximum.reduceat(raw, first[:-1])
    e = np.exp(raw - top[rows])
    weight = e / np.add.reduceat(e, first[:-1])[rows]
    z = np.add.reduceat(weight[:, None] * h, first[:-1], axis=0)
    logit = np.clip(z @ model.out[:-1] + model.out[-1], -30, 30)
    return {"rows": rows, "h": h, "t": t, "g": g, "weight": weight, "z": z, "score": 1 / (1 + np.exp(-logit))}


def fit_arrays(features: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Model:
    """Full-batch Adam on the weighted log loss with a small penalty."""
    generator = np.random.default_rng(SEED)
    d = features.shape[1] + 1
    centre, scale = features.mean(0), features.std(0) + 1e-6
    shapes = {"encode": (d, HIDDEN), "tanh": (HIDDEN, ATTENTION), "gate": (HIDDEN, ATTENTION), "attend": (ATTENTION,), "out": (HIDDEN + 1,)}
    p = {k: generator.normal(0, 0.3, s) for k, s in shapes.items()}
    m, v = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    weight = weight / weight.sum()
    inputs = encoded(Model(centre, scale, **p), features)
    for step in range(1, STEPS + 1):
        model = Model(centre, scale, **p)
        f = forward(model, inputs, first)
        rows, h, t, g, a, z = (f[k] for k in ("rows", "h", "t", "g", "weight", "z"))
        d_logit = (f["score"] - label) * weight
        grad = {"out": np.append(z.T @ d_logit, d_logit.sum())}
        d_z = d_logit[:, None] * model.out[None, :-1]
        d_h = a[:, None] * d_z[rows]
        d_a = np.einsum("ij,ij->i", h, d_z[rows])
        d_raw = a * (d_a - np.add.reduceat(a * d_a, first[:-1])[rows])
        grad["attend"] = (t * g).T @ d_raw
        d_tg = d_raw[:, None] * model.attend
        d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
        grad["tanh"], grad["gate"] = h.T @ d_t, h.T @ d_g
        d_h += d_t @ model.tanh.T + d_g @ model.gate.T
        grad["encode"] = inputs.T @ (d_h * (1 - h * h))
        rate = 0.03 * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k in p:
            slope = grad[k] + 1e-5 * p[k]
            m[k] = 0.9 * m[k] + 0.1 * slope
            v[k] = 0.99 * v[k] + 0.01 * slope**2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
    return Model(centre, scale, **p)


def fold(doc_id: str, folds: int) -> Column:
    """Remainder of the CRC-32 of the id's text; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def labelled_sample(labels: DataFrame, column: str, folds: int, held: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` training ids of each label (doc_id, label), and the labels' counts."""
    usable = labels.filter(F.col(column).isin(0, 1) & (fold("doc_id", folds) != held))
    once = usable.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    counts = {r.label: r["count"] for r in once.groupBy("label").count().collect()}
    order = [F.xxhash64(F.lit(SEED), "doc_id"), F.col("doc_id")]
    parts = [once.filter(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1]), counts


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = 4, held: int = 2, per_class: int = FIT_PER_CLASS) -> Model | None:
    """Fit on a bounded sample of labelled documents; None where a class is missing."""
    sample, counts = labelled_sample(labels, column, folds, held, per_class)
    if len(counts) < 2:
        return None
    sample = sample.withColumnRenamed("doc_id", "_id")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))

    def bags(piece: Slice) -> pa.RecordBatch:
        features, first = passages(piece)
        cut = [features[a:b].astype(np.float32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [piece.rows.column("doc_id").cast(pa.int64()), piece.rows.column("label").cast(pa.int32()), pa.array(cut, pa.binary())],
            ["doc_id", "label", "bag"],
        )

    made = texts.select("doc_id", "text", "label").mapInArrow(mapped(bags, "text"), "doc_id long, label int, bag binary")
    once = made.groupBy("doc_id", "label").agg(F.min("bag").alias("bag"))
    rows = sorted(once.collect(), key=lambda r: r.doc_id)  # at most 2 * per_class bags
    label = np.array([r.label for r in rows], float)
    if not 0 < label.sum() < len(label):
        return None
    cut = [np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
    total = sum(counts.values())
    weight = np.where(label == 1, counts[1] / total / label.sum(), counts[0] / total / (1 - label).sum())
    # half by share, half evenly, so that a rare class is not ignored
    weight += np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum())
    return fit_arrays(np.concatenate(cut).astype(float), first, label, weight)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row; 0.5 for all without a model."""
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.5).alias("score"))

    def scored(piece: Slice) -> pa.RecordBatch:
        features, first = passages(piece)
        value = forward(model, encoded(model, features), first)["score"]
        return pa.RecordBatch.from_arrays([piece.rows.column("doc_id"), pa.array(value)], ["doc_id", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(mapped(scored, "text"), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """Documents that score at least the threshold, with their columns; all of them without a model."""
    if model is None:
        return docs
    names = docs.columns
    place = names.index("text")

    def kept(piece: Slice) -> pa.RecordBatch:
        features, first = passages(piece)
        value = forward(model, encoded(model, features), first)["score"]
        return piece.rows.filter(pa.array(value >= threshold))

    assert place >= 0
    return docs.mapInArrow(mapped(kept, "text"), docs.schema)
