"""Random forest grown level by level from histograms of binned features.

Training rows are binned once (at most ``BINS`` bins a feature, by quantiles) and laid down packed, some bytes a row. How often a tree's bootstrap
draws a row (Poisson with mean 1) follows from the row's hash, the tree and the seed, so nothing is stored per tree and any cluster grows the same
forest. Each tree weighs classes by their balance in its own bootstrap. A node looks at the root of the number of features, drawn by its place, and at
further ones only where none of these can split it.

Nodes with more than ``LOCAL_ROWS`` rows are split by a Spark aggregation: tasks count (bin, class) cells of
their rows for a bounded number of nodes per pass, and the counts of a node meet in one group that chooses its split. The rows of a smaller node
are sent to one group, which grows the whole subtree below it. Counts are integers, so sums do not depend on their order.

A grown forest is held whole by the driver and by each scoring task; its size is bounded by the depth and the least number of rows of a leaf.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vibralake.functions import numeric
from vibralake.operators import scaling
from vibralake.session import PACKED as FILES
from vibralake.session import discard, written

BINS = 32
# A node of up to so many rows is finished in one group.
LOCAL_ROWS = 100_000
# Counts that a task holds in a pass over the rows.
PASS_CELLS = 16_000_000
# Cells that a group holds at once while it finishes a subtree.
LEVEL_CELLS = 2_000_000
# Rows that are dealt out at once to finish subtrees, at least, and bootstraps that they come to beyond that: disk does not grow with rows times trees.
DEALT_ROWS, DEALT_TREES = 16_000_000, 4
MOST_CLASSES = 32_000
# Cumulative chances of drawing a row 0, 1, 2, ... times.
DRAWS = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(12)])

PACKED = "n int, bins binary, labels binary, draws binary"
NODES = "tree int, node long, feature int, bin int, gain double, counts array<long>"


def scrambled(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def drawn(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often the tree's bootstrap holds each row."""
    own = scrambled(np.array([(seed << 20) + tree + 1], np.uint64))
    chance = (scrambled(rows.view(np.uint64) ^ own) >> np.uint64(11)).astype(float) / 2.0**53
    return np.searchsorted(DRAWS, chance, "right").astype(np.int64)


def feature_order(tree: int, nodes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A random order of the features for each node."""
    own = scrambled(nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed << 20) + tree + 7))
    keys = scrambled(own[:, None] + np.arange(1, width + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03))
    return np.argsort(keys, axis=1, kind="stable")


@dataclass(frozen=True)
class Limits:
    """What a node has to keep to, and the number of classes, features and bins."""

    classes: int
    width: int
    depth: int
    leaf_rows: int
    split_rows: int
    seed: int

    @property
    def tried(self) -> int:
        return max(1, int(self.width**0.5))


def cells(bins: np.ndarray, labels: np.ndarray, counts: np.ndarray, node: np.ndarray, nodes: int, chosen: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Draws per (node, chosen feature, bin, class) and rows per (node, chosen feature, bin)."""
    tried = chosen.shape[1]
    draws, rows = np.zeros(nodes * tried * BINS * classes), np.zeros(nodes * tried * BINS, np.int64)
    place = np.arange(len(bins))
    for j in range(tried):
        at = (node * tried + j) * BINS + bins[place, chosen[node, j]]
        rows += np.bincount(at, minlength=len(rows))
        draws += np.bincount(at * classes + labels, counts, minlength=len(draws))
    return draws.reshape(nodes, tried, BINS, classes), rows.reshape(nodes, tried, BINS)


def best_splits(draws: np.ndarray, rows: np.ndarray, weights: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the chosen feature, bin and gain of each node's best split by weighted Gini impurity; the gain is -1 where none is allowed."""
    held = draws * weights
    left = np.cumsum(held, axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left
    n_left = np.cumsum(rows, axis=2)
    n_right = n_left[:, :, -1:] - n_left

    def purity(x: np.ndarray) -> np.ndarray:
        total = x.sum(axis=-1)
        return np.divide((x * x).sum(axis=-1), total, out=np.zeros_like(total), where=total > 0)

    gain = purity(left) + purity(right) - purity(whole)
    gain = np.where((n_left >= leaf_rows) & (n_right >= leaf_rows), np.maximum(gain, 0.0), -1.0).reshape(len(draws), -1)
    best = gain.argmax(axis=1)
    return best // BINS, best % BINS, gain[np.arange(len(gain)), best]


def grown(
    tree: int, root: int, bins: np.ndarray, labels: np.ndarray, counts: np.ndarray, weights: np.ndarray, limits: Limits
) -> list[tuple[int, int, int, int, float, list[int]]]:
    """All nodes below and with ``root`` from the rows that reach it: (tree, node, feature or -1, bin, gain, draws per class).

    Node n has the children 2 n and 2 n + 1.
    """
    out = []
    numbers, node = np.array([root], np.int64), np.zeros(len(bins), np.int64)
    while len(numbers):
        classes = np.bincount(node * limits.classes + labels, counts, minlength=len(numbers) * limits.classes).reshape(-1, limits.classes).astype(np.int64)
        sizes = np.bincount(node, minlength=len(numbers))
        level = int(numbers[0]).bit_length() - 1
        open_ = (sizes >= limits.split_rows) & ((classes > 0).sum(axis=1) > 1) & (level < limits.depth)
        feature, cut, gains = np.full(len(numbers), -1), np.full(len(numbers), -1), np.zeros(len(numbers))
        order = feature_order(tree, numbers, limits.width, limits.seed)
        by_node = np.argsort(node, kind="stable")
        starts = np.searchsorted(node[by_node], np.arange(len(numbers) + 1))
        waiting, offset = np.flatnonzero(open_), 0
        while len(waiting) and offset < limits.width:
            chosen = order[:, offset : offset + limits.tried]
            step = max(1, LEVEL_CELLS // (chosen.shape[1] * BINS * limits.classes))
            for at in range(0, len(waiting), step):
                part = waiting[at : at + step]
                rows = np.concatenate([by_node[starts[p] : starts[p + 1]] for p in part.tolist()])
                own = np.repeat(np.arange(len(part)), sizes[part])
                draws, n = cells(bins[rows], labels[rows], counts[rows], own, len(part), chosen[part], limits.classes)
                slot, bin_, gain = best_splits(draws, n, weights, limits.leaf_rows)
                done = gain >= 0
                feature[part[done]], cut[part[done]], gains[part[done]] = chosen[part[done], slot[done]], bin_[done], gain[done]
            waiting, offset = waiting[feature[waiting] < 0], offset + limits.tried
        out += zip([tree] * len(numbers), numbers.tolist(), feature.tolist(), cut.tolist(), gains.tolist(), classes.tolist(), strict=True)
        split = feature >= 0
        kept = split[node]
        bins, labels, counts, node = bins[kept], labels[kept], counts[kept], node[kept]
        right = bins[np.arange(len(bins)), feature[node]] > cut[node]
        children = np.stack([2 * numbers[split], 2 * numbers[split] + 1], axis=1).ravel()
        node = 2 * (np.cumsum(split) - 1)[node] + right
        numbers = children
    return out


@dataclass
class Packed:
    """Nodes of one tree as arrays, by node number."""

    numbers: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray  # place of the left child; the right one's is stored too
    right: np.ndarray

    @classmethod
    def of(cls, nodes: list[tuple]) -> Packed:
        """From (node, feature, bin) of a partly or wholly grown tree."""
        table = np.array(sorted(nodes), np.int64).reshape(-1, 3)
        numbers, feature, cut = table.T
        find = lambda x: np.minimum(np.searchsorted(numbers, x), len(numbers) - 1)
        return cls(numbers, feature, cut, find(2 * numbers), find(2 * numbers + 1))

    def reached(self, bins: np.ndarray) -> np.ndarray:
        """Place of the node at which each row ends."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            feature = self.feature[at]
            going = feature >= 0
            if not going.any():
                return at
            right = bins[rows, np.maximum(feature, 0)] > self.cut[at]
            at = np.where(going, np.where(right, self.right[at], self.left[at]), at)


def unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bins, labels, draw hashes) of each packed row of training rows."""
    for batch in batches:
        for row in batch.to_pylist():
            yield np.frombuffer(row["bins"], np.uint8).reshape(row["n"], width), np.frombuffer(row["labels"], np.int16).astype(np.int64), np.frombuffer(row["draws"], np.int64)


def quantile_edges(rows: DataFrame, columns: Sequence[str], scale: scaling.Scale) -> list[np.ndarray]:
    """Bounds between bins: midpoints of neighbouring quantiles of the scaled values."""
    shares = [i / (BINS - 1) for i in range(BINS)]
    found = rows.agg(*[F.percentile_approx(numeric.finite_or_zero(F.col(c)), shares, 10_000).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    out = []
    for i, (mean, spread) in enumerate(zip(scale.mean, scale.scale, strict=True)):
        values = (np.unique(np.array(found[f"q{i}"], float)) - mean) / spread
        out.append((values[:-1] + values[1:]) / 2)
    return out


def binned(values: np.ndarray, scale: scaling.Scale, edges: Sequence[np.ndarray]) -> np.ndarray:
    scaled = (np.where(np.isfinite(values), values, 0.0) - np.asarray(scale.mean)) / np.asarray(scale.scale)
    return np.stack([np.searchsorted(e, scaled[:, i], "left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def feature_values(columns: Sequence[str]) -> Column:
    return F.array(*[numeric.finite_or_zero(F.col(c).cast("double")) for c in columns])


def numbers_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


@dataclass
class Small:
    """A grown tree in some 20 bytes a node: children lie side by side, and only leaves have counts, of the classes they hold."""

    feature: np.ndarray  # -1 at a leaf
    cut: np.ndarray
    left: np.ndarray  # place of the left child, of a leaf its number
    starts: np.ndarray  # per leaf where its classes begin
    held: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, node: np.ndarray, feature: np.ndarray, cut: np.ndarray, counts: np.ndarray) -> Small:
        """From the columns of a wholly grown tree, by node number."""
        leaf = feature < 0
        left = np.where(leaf, np.cumsum(leaf) - 1, np.searchsorted(node, 2 * node)).astype(np.int32)
        own, held = np.nonzero(counts[leaf])
        starts = np.searchsorted(own, np.arange(leaf.sum() + 1)).astype(np.int32)
        return cls(feature.astype(np.int32), cut.astype(np.int8), left, starts, held.astype(np.int16), counts[leaf][own, held])

    def reached(self, bins: np.ndarray) -> np.ndarray:
        """Number of the leaf at which each row ends."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            feature = self.feature[at]
            going = feature >= 0
            if not going.any():
                return self.left[at]
            right = bins[rows, np.maximum(feature, 0)] > self.cut[at]
            at = np.where(going, self.left[at] + right, at)

    def drawn(self, leaves: np.ndarray, classes: int) -> np.ndarray:
        """Draws of each class at some leaves."""
        sizes = self.starts[leaves + 1] - self.starts[leaves]
        row = np.repeat(np.arange(len(leaves)), sizes)
        place = np.arange(len(row)) + np.repeat(self.starts[leaves] - (np.cumsum(sizes) - sizes), sizes)
        out = np.zeros((len(leaves), classes), np.int64)
        out[row, self.held[place]] = self.counts[place]
        return out


@dataclass
class Scorer:
    """What a scoring task needs of a forest."""

    scale: scaling.Scale
    edges: list[np.ndarray]
    weights: np.ndarray
    trees: list[Small]

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        """Class shares averaged over the trees."""
        bins, out = binned(values, self.scale, self.edges), np.zeros((len(values), self.weights.shape[1]))
        for k, tree in enumerate(self.trees):
            held = tree.drawn(tree.reached(bins), out.shape[1]) * self.weights[k]
            out += held / held.sum(axis=1, keepdims=True)
        return out / len(self.trees)


@dataclass
class Model:
    """A fitted forest: features, classes in alphabetical order, scale, bin edges and the nodes of every tree."""

    features: list[str]
    classes: list[str]
    scale: scaling.Scale
    edges: list[np.ndarray]
    nodes: pa.Table  # tree, node, feature, bin, gain, counts
    weights: np.ndarray  # of classes, a row per tree
    _opened: Scorer | None = field(default=None, repr=False)

    def opened(self) -> Scorer:
        """The forest as it scores."""
        if self._opened is None:
            tree = self.nodes["tree"].to_numpy()
            node, feature, cut = (self.nodes[c].to_numpy() for c in ("node", "feature", "bin"))
            counts = numbers_of(self.nodes["counts"].combine_chunks(), len(self.classes))
            trees = []
            for k in range(len(self.weights)):
                mine = np.flatnonzero(tree == k)
                mine = mine[np.argsort(node[mine])]
                trees.append(Small.of(node[mine], feature[mine], cut[mine], counts[mine]))
            self._opened = Scorer(self.scale, self.edges, self.weights, trees)
        return self._opened

    def importances(self) -> np.ndarray:
        """Mean over trees of each feature's share of the gain."""
        total = np.zeros(len(self.features))
        tree, feature, gain = (self.nodes[c].to_numpy() for c in ("tree", "feature", "gain"))
        for k in range(len(self.weights)):
            mine = (tree == k) & (feature >= 0)
            sums = np.bincount(feature[mine], gain[mine], minlength=len(self.features))
            total += sums / sums.sum() if sums.sum() > 0 else 0.0
        return total / total.sum() if total.sum() > 0 else total

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        """Class shares averaged over the trees."""
        return self.opened().probabilities(values)


def packed_rows(rows: DataFrame, columns: Sequence[str], label: str, classes: Sequence[str], scale: scaling.Scale, edges: Sequence[np.ndarray]) -> DataFrame:
    """The labelled rows binned and packed, written once; rows equal in all columns are drawn alike."""
    names, width = pa.array(classes, pa.string()), len(columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = binned(numbers_of(batch.column("x"), width), scale, edges)
                labels = pc.index_in(batch.column("y"), value_set=names).to_numpy(zero_copy_only=False).astype(np.int16)
                columns = [batch.num_rows, bins.tobytes(), labels.tobytes(), batch.column("draw").to_numpy().tobytes()]
                types = [pa.int32(), *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, types, strict=True)], ["n", "bins", "labels", "draws"])

    kept = rows.filter(F.col(label).isNotNull())
    values = kept.select(feature_values(columns).alias("x"), F.col(label).cast("string").alias("y"), F.xxhash64(*kept.columns).alias("draw"))
    return written(values.mapInArrow(pack, PACKED), "forest_rows", **FILES)


def summed_cells(rows: DataFrame, trees: dict[int, Packed], wanted: dict[int, list[tuple[int, int]]], weights: np.ndarray, limits: Limits) -> list:
    """The best split of each wanted (node, first feature place) of each tree, from the counts of all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for bins, labels, draws in unpacked(batches, limits.width):
            for tree, nodes in wanted.items():
                numbers = np.array([n for n, _ in nodes], np.int64)
                times = drawn(draws, tree, limits.seed)
                at = trees[tree].numbers[trees[tree].reached(bins)] if tree in trees else np.ones(len(bins), np.int64)
                place = np.minimum(np.searchsorted(numbers, at), len(numbers) - 1)
                mine = np.flatnonzero((times > 0) & (numbers[place] == at))
                order = feature_order(tree, numbers, limits.width, limits.seed)
                chosen = np.stack([order[i, o : o + limits.tried] for i, (_, o) in enumerate(nodes)])
                made = cells(bins[mine], labels[mine], times[mine], place[mine], len(numbers), chosen, limits.classes)
                before = held.get(tree)
                held[tree] = (chosen, *made) if before is None else (chosen, before[1] + made[0], before[2] + made[1])
        for tree, (chosen, draws, n) in held.items():
            for i, (node, _) in enumerate(wanted[tree]):
                columns = [[tree], [node], [chosen[i].tolist()], [draws[i].astype(np.int64).tobytes()], [n[i].tobytes()]]
                types = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["tree", "node", "chosen", "draws", "rows"])

    def choose(table: pa.Table) -> pa.Table:
        chosen = table["chosen"][0].as_py()
        shape = (1, len(chosen), BINS, limits.classes)
        draws = sum(np.frombuffer(x.as_py(), np.int64) for x in table["draws"]).reshape(shape)
        rows = sum(np.frombuffer(x.as_py(), np.int64) for x in table["rows"]).reshape(shape[:3])
        tree = table["tree"][0].as_py()
        slot, bin_, gain = best_splits(draws, rows, weights[tree], limits.leaf_rows)
        left, n_left = draws[0, slot[0], : bin_[0] + 1].sum(axis=0), int(rows[0, slot[0], : bin_[0] + 1].sum())
        whole, n = draws[0, 0].sum(axis=0), int(rows[0, 0].sum())
        row = {"tree": tree, "node": table["node"][0].as_py(), "feature": chosen[slot[0]], "bin": int(bin_[0]), "gain": float(gain[0]), "counts": whole.tolist(),
               "left": left.tolist(), "n_left": n_left, "n": n}
        return pa.Table.from_pylist([row], pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("feature", pa.int32()), ("bin", pa.int32()), ("gain", pa.float64()),
                                                      ("counts", pa.list_(pa.int64())), ("left", pa.list_(pa.int64())), ("n_left", pa.int64()), ("n", pa.int64())]))

    partial = rows.mapInArrow(count, "tree int, node long, chosen array<int>, draws binary, rows binary")
    return partial.groupBy("tree", "node").applyInArrow(choose, f"{NODES}, left array<long>, n_left long, n long").collect()


def finished(rows: DataFrame, trees: dict[int, Packed], wanted: dict[int, list[int]], weights: np.ndarray, limits: Limits) -> DataFrame:
    """The nodes of all subtrees whose rows fit one group."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, labels, draws in unpacked(batches, limits.width):
            for tree, numbers in wanted.items():
                times = drawn(draws, tree, limits.seed)
                at = trees[tree].numbers[trees[tree].reached(bins)] if tree in trees else np.ones(len(bins), np.int64)
                mine = np.flatnonzero((times > 0) & np.isin(at, numbers))
                mine = mine[np.argsort(at[mine], kind="stable")]
                edges = np.flatnonzero(np.diff(at[mine], prepend=-1, append=-1))
                made = [
                    (tree, int(at[mine[a]]), b - a, bins[mine[a:b]].tobytes(), labels[mine[a:b]].astype(np.int16).tobytes(), times[mine[a:b]].astype(np.uint8).tobytes())
                    for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)
                ]
                if made:
                    types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3]
                    names = ["tree", "node", "n", "bins", "labels", "times"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names)

    def grow(table: pa.Table) -> pa.Table:
        joined = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        bins = joined("bins", np.uint8).reshape(-1, limits.width)
        tree, node = table["tree"][0].as_py(), table["node"][0].as_py()
        made = grown(tree, node, bins, joined("labels", np.int16).astype(np.int64), joined("times", np.uint8).astype(np.int64), weights[tree], limits)
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], ["tree", "node", "feature", "bin", "gain", "counts"])

    dealt = rows.mapInArrow(deal, "tree int, node long, n int, bins binary, labels binary, times binary")
    return dealt.groupBy("tree", "node").applyInArrow(grow, NODES)


def rounds(local: dict[int, dict[int, int]], most: int) -> Iterator[dict[int, list[int]]]:
    """The subtrees (tree, node: rows) in parts of some ``most`` rows at most, a larger subtree alone."""
    part, held = {}, 0
    for tree, nodes in local.items():
        for node, n in nodes.items():
            if part and held + n > most:
                yield part
                part, held = {}, 0
            part.setdefault(tree, []).append(node)
            held += n
    if part:
        yield part


def bootstrap_counts(rows: DataFrame, trees: int, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Draws per class, and rows, of every tree's bootstrap."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((trees, limits.classes + 1), np.int64)
        for _, labels, draws in unpacked(batches, limits.width):
            for tree in range(trees):
                times = drawn(draws, tree, limits.seed)
                total[tree, :-1] += np.bincount(labels, times, minlength=limits.classes).astype(np.int64)
                total[tree, -1] += (times > 0).sum()
        tree, place = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(place), pa.array(total.ravel())], ["tree", "place", "n"])

    out = np.zeros((trees, limits.classes + 1), np.int64)
    summed = rows.mapInArrow(count, "tree int, place int, n long").groupBy("tree", "place").agg(F.sum("n").alias("n"))
    for r in summed.collect():  # trees x classes rows
        out[r.tree, r.place] = r.n
    return out[:, :-1], out[:, -1]


def balanced(counts: np.ndarray) -> np.ndarray:
    """n / (classes present * n of the class), per tree."""
    present = (counts > 0).sum(axis=1, keepdims=True)
    return np.divide(counts.sum(axis=1, keepdims=True), present * counts, out=np.zeros(counts.shape), where=counts > 0)


def fit(
    rows: DataFrame, features: Sequence[str], label: str, trees: int, depth: int, leaf_rows: int, split_rows: int, seed: int, scale: scaling.Scale | None = None
) -> Model:
    """Fit on the rows that have a label; ValueError where there are none."""
    scale = scale or scaling.fit_columns(rows, features)
    names = rows.select(F.col(label).cast("string").alias("y")).filter("y is not null").distinct().limit(MOST_CLASSES + 1).collect()
    classes = sorted(r.y for r in names)
    if not classes or len(classes) > MOST_CLASSES:
        raise ValueError(f"a forest needs 1 to {MOST_CLASSES} classes, there are {len(classes)}")
    edges = quantile_edges(rows.filter(F.col(label).isNotNull()), features, scale)
    limits = Limits(len(classes), len(features), depth, leaf_rows, split_rows, seed)
    stored = packed = packed_rows(rows, features, label, classes, scale, edges)
    # small data lie in few files; the trees' work is dealt out all the same
    packed = packed.repartition(packed.sparkSession.sparkContext.defaultParallelism) if packed.rdd.getNumPartitions() == 1 else packed
    counts, sizes = bootstrap_counts(packed, trees, limits)
    weights = balanced(counts)
    made: list[tuple] = []
    local: dict[int, dict[int, int]] = {}
    waiting = []
    for tree in range(trees):
        if sizes[tree] > LOCAL_ROWS:
            waiting.append((tree, 1, 0))
        elif sizes[tree]:
            local[tree] = {1: int(sizes[tree])}
        else:  # an empty bootstrap knows nothing
            made.append((tree, 1, -1, -1, 0.0, [1] * len(classes)))
            weights[tree] = 1.0
    partly: dict[int, list[tuple[int, int, int]]] = {}
    step = max(1, PASS_CELLS // (limits.tried * BINS * limits.classes))
    while waiting:
        now, waiting = sorted(waiting[:step]), waiting[step:]
        wanted: dict[int, list[tuple[int, int]]] = {}
        for tree, node, offset in now:
            wanted.setdefault(tree, []).append((node, offset))
        opened = {t: Packed.of(partly[t]) for t in wanted if t in partly}
        places = {(t, n): o for t, n, o in now}
        for r in summed_cells(packed, opened, wanted, weights, limits):
            offset = places[r.tree, r.node]
            if r.gain < 0 and offset + limits.tried < limits.width:
                waiting.append((r.tree, r.node, offset + limits.tried))
                continue
            own = partly.setdefault(r.tree, [])
            own[:] = [x for x in own if x[0] != r.node]
            if r.gain < 0:
                made.append((r.tree, r.node, -1, -1, 0.0, list(r.counts)))
                own.append((r.node, -1, -1))
                continue
            made.append((r.tree, r.node, r.feature, r.bin, r.gain, list(r.counts)))
            own.append((r.node, r.feature, r.bin))
            sides = ((2 * r.node, r.left, r.n_left), (2 * r.node + 1, [a - b for a, b in zip(r.counts, r.left, strict=True)], r.n - r.n_left))
            for child, held, n in sides:
                own.append((child, -1, -1))
                level = child.bit_length() - 1
                if n < split_rows or level >= depth or sum(x > 0 for x in held) < 2:
                    made.append((r.tree, child, -1, -1, 0.0, list(held)))
                elif n > LOCAL_ROWS:
                    waiting.append((r.tree, child, 0))
                else:
                    local.setdefault(r.tree, {})[child] = n
    opened = {t: Packed.of(partly[t]) for t in local if t in partly}
    fields = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("feature", pa.int32()), ("bin", pa.int32()), ("gain", pa.float64()), ("counts", pa.list_(pa.int64()))])
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True) if made else [[]] * 6, fields, strict=True)], schema=fields)
    for part in rounds(local, max(DEALT_ROWS, DEALT_TREES * int(sizes.max(initial=0)))):
        table = pa.concat_tables([table, finished(packed, opened, part, weights, limits).toArrow().cast(fields)])
    discard(stored)
    return Model(list(features), classes, scale, edges, table.sort_by([("tree", "ascending"), ("node", "ascending")]), weights)


def with_probabilities(model: Model, events: DataFrame, name: str) -> DataFrame:
    """Add the class shares of every row as an array; a batch at a time, on batch and streaming frames."""
    held = events.sparkSession.sparkContext.broadcast(model.opened())
    width = len(model.features)

    @F.pandas_udf("array<double>")
    def shares(values):
        import pandas as pd

        rows = np.stack(values.to_numpy()).astype(float) if len(values) else np.zeros((0, width))
        return pd.Series(list(held.value.probabilities(rows)))

    return events.withColumn(name, shares(feature_values(model.features)))


def save(model: Model, path: str) -> None:
    """Nodes as parquet and the rest as JSON under ``path``."""
    spark = SparkSession.active()
    spark.createDataFrame(model.nodes).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    rest = {
        "features": model.features, "classes": model.classes, "mean": list(model.scale.mean), "scale": list(model.scale.scale),
        "edges": [e.tolist() for e in model.edges], "weights": model.weights.tolist(),
    }
    spark.createDataFrame([(json.dumps(rest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load(path: str) -> Model:
    spark = SparkSession.active()
    rest = json.loads(spark.read.text(f"{path}/settings").first()["value"])
    nodes = spark.read.parquet(f"{path}/nodes").toArrow()
    edges = [np.array(e, float) for e in rest["edges"]]
    return Model(rest["features"], rest["classes"], scaling.Scale(rest["mean"], rest["scale"]), edges, nodes, np.array(rest["weights"], float))
