"""Documents whose word shingles have a Jaccard similarity of a threshold or more.

The documents and their shingles form a sparse incidence matrix; entries of its
product with its transpose are overlaps. The columns are cut into blocks by the
shingles' hashes, and only products that can matter are taken:

* Two sets of sizes a and b that link differ in at most D = (a + b)(1 - t)/(1 + t)
  shingles. With more than D filled column blocks, one block at least holds the same shingles in
  both. So a document sends one signature for each filled block, and only documents
  with an equal one meet. The number of blocks follows from the size, by levels; a document also sends
  the next level's signatures if a partner can be there. A set that fills too few
  blocks for this argument (hash accidents in tiny sets) is joined by its
  prefix instead: the shingles of smallest hash, one of which every partner shares.
* Equal blocks are accumulated per class and leader, the class of a signature with most signatures in common with
  others; each class is first compared with the leader it shares most blocks with.
* Of the classes of several components, those are discarded whose entries in common with other components are fewer than
  the sizes demand. Pairs of what remains are compared in full, unless they are connected already.
* Every comparison is the exact overlap of the whole sets.

Documents with equal sets are one class from the start. So groups of near copies cost about a comparison a
document, no pairs of copies are made, and no link between different components is lost.

Shingles are 64-bit hashes of words; an overlap is wrong only if two shingles of the same pair collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vibralake.llm.graph import components
from vibralake.llm.texts import U64, Slice, mapped, mix, owners, signed, unused
from vibralake.session import written

WORDS = 4
THRESHOLD = Fraction(85, 100)
SLACK = 4
TERMS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class Levels:
    """Size levels and, for each, its largest size and the number of column blocks."""

    def __init__(self, threshold: Fraction, slack: int):
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, int(bounds[-1] / float(threshold) * 1.2)))
        self.lower = np.array(bounds[:-1], np.int64)
        share = (1 - threshold) / (1 + threshold)
        most = [int(2 * share * (b - 1)) for b in bounds[1:]]
        self.upper = np.array(bounds[1:], np.int64) - 1
        self.blocks = np.array([max(1, d + 1 + slack + d // 12) if slack >= 0 else 1 for d in most], np.int64)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lower, size, "right") - 1


def shingle_sets(piece: Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, ascending within a row, and each row's first."""
    words, bounds = piece.word_names()
    rows, count = owners(bounds), np.diff(bounds)
    size = np.minimum(count, k)
    full = np.arange(len(words)) + size[rows] <= bounds[1:][rows]
    start = np.flatnonzero(full)
    total = np.zeros(len(start), U64)
    of = rows[start]
    for j in range(k):
        inside = j < size[of]
        at = np.where(inside, start + j, 0)
        total += np.where(inside, mix(words[at] + U64(j)) * U64(TERMS[j % len(TERMS)]), U64(0)) if len(words) else U64(0)
    hashes = mix(total + size[of].astype(U64))
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[fresh], of[fresh]
    return hashes, np.searchsorted(of, np.arange(len(bounds)))


def run_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 between consecutive bounds; empty runs give 0."""
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
    return sums[first[1:]] - sums[first[:-1]]


def classes_of(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name for each row's set."""
    one = run_sums(mix(hashes ^ U64(TERMS[0])), first)
    two = run_sums(mix(hashes ^ U64(TERMS[1])), first)
    return mix(one + mix(two ^ np.diff(first).astype(U64)))


def block_signatures(hashes: np.ndarray, first: np.ndarray, levels: Levels, threshold: Fraction):
    """Row and signature of each filled block of each row; the row's least number of filled blocks, and whether it is too few."""
    size = np.diff(first)
    out_rows, out_signs, few, least = [], [], np.zeros(len(size), bool), size.astype(np.int64)
    own = levels.of(np.maximum(size, 1))
    up, down = threshold.numerator, threshold.denominator
    reach = levels.of(np.maximum(size * threshold.denominator // threshold.numerator, 1))
    for step in (0, 1):
        chosen = np.flatnonzero((size > 0) & (own + step <= reach))
        if not len(chosen):
            continue
        level = own[chosen] + step
        of = np.repeat(np.arange(len(chosen)), size[chosen])
        at = np.arange(len(of)) - np.repeat(np.cumsum(size[chosen]) - size[chosen], size[chosen]) + first[:-1][chosen][of]
        h, m = hashes[at], levels.blocks[level][of].astype(U64)
        block = ((h >> U64(32)) * m) >> U64(32)
        start = np.ones(len(h), bool)
        start[1:] = (of[1:] != of[:-1]) | (block[1:] != block[:-1])
        edges = np.append(np.flatnonzero(start), len(h))
        sums = run_sums(mix(h ^ U64(TERMS[2])), edges)
        row, where = of[edges[:-1]], block[edges[:-1]]
        out_rows.append(chosen[row])
        out_signs.append(mix(sums + mix(where + (level[row].astype(U64) << U64(40)))))
        filled = np.bincount(row, minlength=len(chosen))
        least[chosen] = np.minimum(least[chosen], filled)
        # the largest partner of this level bounds the difference
        partner = np.minimum(size[chosen] * down // up, levels.upper[level])
        few[chosen] |= filled <= (down - up) * (size[chosen] + partner) // (down + up)
    if not out_rows:
        return np.zeros(0, np.int64), np.zeros(0, U64), least, few
    return np.concatenate(out_rows), np.concatenate(out_signs), least, few


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def same_signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep rows (sign, cls, n), sorted by sign and class, whose signature several classes have; repeated rows once."""
    carry, out = None, False
    for b in batches:
        rows = pa.Table.from_batches([b] if carry is None else [carry, b]).combine_chunks()
        sign, cls = rows["sign"].to_numpy(), rows["cls"].to_numpy()
        if not len(sign):
            continue
        fresh = np.ones(len(sign), bool)
        fresh[1:] = (sign[1:] != sign[:-1]) | (cls[1:] != cls[:-1])
        rows, sign = rows.filter(pa.array(fresh)), sign[fresh]
        # of an open run keep two rows, so that what follows is known to be shared
        last = np.searchsorted(sign == sign[-1], True)
        cut = last if len(sign) - last <= 1 else len(sign) - 1
        keep = np.zeros(len(sign), bool)
        keep[1:] = sign[1:] == sign[:-1]
        keep[:-1] |= sign[1:] == sign[:-1]
        keep[0] &= not out
        done = rows.slice(0, cut).filter(pa.array(keep[:cut]))
        yield from done.to_batches()
        tail = rows.slice(cut)
        carry = tail.to_batches()[0] if tail.num_rows else None
        out = len(sign) - last > 1 or (out and len(sign) == 1)
        if out and len(sign) > 1:
            yield carry  # a shared run goes on: its latest row is out, and stays as the mark for the next batch
    # an open run of one row is not shared; of a longer one all rows are out


def differing(a: Column, b: Column, threshold: Fraction) -> Column:
    """The most shingles in which linked sets of these sizes can differ."""
    up, down = threshold.numerator, threshold.denominator
    return F.floor((a + b) * (down - up) / (down + up))


def verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs (a, b) of classes whose whole sets reach the threshold."""
    up, down = threshold.numerator, threshold.denominator

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for one, two in zip(b.column("set_a"), b.column("set_b"), strict=True):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(down * both >= up * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("cls").alias("a"), F.col("members").alias("set_a")), "a")
    two = one.join(sets.select(F.col("cls").alias("b"), F.col("members").alias("set_b")), "b")
    return two.select("a", "b", "set_a", "set_b").mapInArrow(decide, "a long, b long")


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, tag, text: the tag is 0, and tells texts without an id apart."""
    id_ = F.col("doc_id").cast("long")
    return docs.select(id_.alias("doc_id"), F.when(id_.isNull(), F.xxhash64("text")).otherwise(0).alias("tag"), "text")


def first_of(*columns: str) -> Column:
    """The smallest id of a group with its tag; a null id comes after all others."""
    id_, tag = columns
    return F.min(F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("doc_id"), F.col(tag).alias("tag")))


def link(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD, slack: int = SLACK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A-Z are lower-cased; a text with fewer words than a shingle is one shingle;
    null and blank texts have none and link with nothing. ``component_id`` is the smallest
    id reachable by links. Repeated rows, and texts of one id, are documents of their own; a
    component whose ids are all null has a null id.
    """
    return linked(tagged(docs), words, threshold, slack).select("doc_id", "n_shingles", "component_id")


def linked(plain: DataFrame, words: int, threshold: Fraction, slack: int = SLACK) -> DataFrame:
    """doc_id, tag, n_shingles, component_id, component_tag of ``tagged`` documents."""
    levels, up, down = Levels(threshold, slack), threshold.numerator, threshold.denominator

    def describe(piece: Slice) -> pa.RecordBatch:
        hashes, first = shingle_sets(piece, words)
        _, _, filled, few = block_signatures(hashes, first, levels, threshold)
        return batch(
            doc_id=piece.rows.column("doc_id"), tag=piece.rows.column("tag"), n_shingles=pa.array(np.diff(first).astype(np.int64)),
            cls=signed(classes_of(hashes, first)), filled=pa.array(filled), few=pa.array(few),
        )

    def signatures(piece: Slice) -> pa.RecordBatch:
        hashes, first = shingle_sets(piece, words)
        rows, signs, _, _ = block_signatures(hashes, first, levels, threshold)
        return batch(sign=signed(signs), cls=signed(classes_of(hashes, first)[rows]))

    known = written(plain.mapInArrow(mapped(describe, "text", lower=True), "doc_id long, tag long, n_shingles long, cls long, filled long, few boolean"), "sets")
    classes = known.filter("n_shingles > 0").groupBy("cls").agg(first_of("doc_id", "tag").alias("first"), F.max("n_shingles").alias("n"), F.max("filled").alias("filled"), F.max("few").alias("few"))
    classes = written(classes, "classes")
    sent = plain.mapInArrow(mapped(signatures, "text", lower=True), "sign long, cls long")
    sorted_ = sent.repartition("sign").sortWithinPartitions("sign", "cls")
    shared = written(sorted_.mapInArrow(same_signature, "sign long, cls long"), "shared")

    # a class whose filled blocks are not all but those that may differ found elsewhere links with none
    most = F.floor(F.col("n") * down / up)
    met = shared.groupBy("cls").agg(F.count("*").alias("met")).join(classes, "cls")
    likely = met.filter(F.col("met") >= F.col("filled") - differing(F.col("n"), most, threshold)).select("cls", "n", "filled", "met")
    likely = written(likely, "likely")
    shared = written(shared.join(likely.select("cls", "met"), "cls"), "shared")

    wanted = shared.select("cls")
    extra = None
    if not classes.filter("few").isEmpty():
        extra = written(prefix_pairs(plain, classes, words, threshold), "prefix")
        wanted = wanted.unionByName(extra.select(F.col("a").alias("cls"))).unionByName(extra.select(F.col("b").alias("cls")))
    involved = wanted.distinct().join(classes, "cls").select(F.col("first.doc_id").alias("_id"), F.col("first.tag").alias("_tag"))
    sets = members(plain, involved, words)

    # the class with most shared signatures leads: among near copies the one that the others were made from
    leader = shared.groupBy("sign").agg(F.max_by("cls", F.struct("met", "cls")).alias("b"))
    led = shared.join(leader, "sign").filter("cls <> b").groupBy(F.col("cls").alias("a"), "b").agg(F.count("*").alias("equal"))
    best = led.groupBy("a").agg(F.max(F.struct("equal", "b")).alias("m")).select("a", "m.b", "m.equal")
    sized = best.join(likely.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), "filled"), "a")
    sized = sized.join(likely.select(F.col("cls").alias("b"), F.col("n").alias("n_b")), "b")
    first = sized.filter(F.col("equal") >= F.col("filled") - differing(F.col("n_a"), F.col("n_b"), threshold)).select("a", "b")
    first = first if extra is None else first.unionByName(extra).distinct()
    edges = written(verified(first, sets, threshold), "links")
    roots = components(edges)
    edges = edges.unionByName(written(verified(across(shared, roots, likely, sets, threshold), sets, threshold), "links"))
    roots = components(edges)

    placed = classes.join(roots.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component"))
    found = placed.join(smallest, "root").select("cls", "component")
    rows = known.join(found, "cls", "left")
    own = F.struct("doc_id", "tag")
    component = F.when(F.col("n_shingles") > 0, F.struct("component.doc_id", "component.tag")).otherwise(own)
    rows = rows.withColumn("component", component)
    return rows.select("doc_id", "tag", "n_shingles", F.col("component.doc_id").alias("component_id"), F.col("component.tag").alias("component_tag"))


def members(plain: DataFrame, involved: DataFrame, words: int) -> DataFrame:
    """(cls, members) for one document of every class in ``involved``."""

    def whole(piece: Slice) -> pa.RecordBatch:
        hashes, first = shingle_sets(piece, words)
        made = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        return batch(cls=signed(classes_of(hashes, first)), members=pa.array(made, pa.binary()))

    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))
    some = plain.join(involved.distinct(), same, "left_semi")
    made = written(some.mapInArrow(mapped(whole, "text", lower=True), "cls long, members binary"), "members")
    return made.dropDuplicates(["cls"]) if made.count() > made.select("cls").distinct().count() else made


def with_roots(rows: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """Add ``root_<column>``, the root of the class in ``column``."""
    named = roots.select(F.col("id").alias(column), F.col("root").alias(f"root_{column}"))
    return rows.join(named, column, "left").withColumn(f"root_{column}", F.coalesce(f"root_{column}", column))


def across(shared: DataFrame, roots: DataFrame, classes: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """All pairs of unconnected classes that can still link.

    Only signatures that classes of several components have take part, and only
    classes with shingles enough in common with other components. Of their entries, those seen least come first; a class
    that needs an overlap of c of its n with a partner meets it among its first n - c + 1.
    """
    up, down = threshold.numerator, threshold.denominator
    placed = with_roots(shared, "cls", roots)
    mixed = placed.groupBy("sign").agg(F.min("root_cls").alias("x"), F.max("root_cls").alias("y")).filter("x <> y").select("sign")
    rows = written(placed.join(mixed, "sign").join(classes.select("cls", "n"), "cls"), "mixed")
    live, entries = able(rows, sets, threshold)
    seen = entries.groupBy("shingle").agg(F.count("*").alias("seen"), F.min("root").alias("x"), F.max("root").alias("y"))
    ranked = entries.join(seen, "shingle").withColumn("rank", F.row_number().over(Window.partitionBy("cls").orderBy("seen", "shingle")))
    rare = ranked.join(live.select("cls", "n", "need"), "cls").filter((F.col("rank") <= F.col("n") - F.col("need") + 1) & (F.col("x") != F.col("y")))
    rare = written(rare.select("shingle", "cls", "n", "root", "rank"), "rare")
    one = rare.select("shingle", F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"), F.col("rank").alias("rank_a"))
    two = rare.select("shingle", F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"), F.col("rank").alias("rank_b"))
    overlap = F.ceil((F.col("n_a") + F.col("n_b")) * up / (up + down))
    fit = (F.col("rank_a") <= F.col("n_a") - overlap + 1) & (F.col("rank_b") <= F.col("n_b") - overlap + 1)
    met = one.join(two, "shingle").filter((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & fit)
    return met.select("a", "b").distinct()


def able(rows: DataFrame, sets: DataFrame, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """Classes of (sign, cls, n, root_cls) that may link with one of another component, and their shingles.

    A class of size a that links with one of size b has up (a + b) / (up + down) shingles in common with
    it. The least b is that of its signatures' classes; the shingles in
    common with any other component are counted. A class with too few goes, which may leave others with too few, until none goes.
    """
    up, down = threshold.numerator, threshold.denominator
    small = rows.groupBy("sign").agg(F.min("n").alias("least"))
    sized = rows.join(small, "sign").groupBy("cls").agg(F.min("least").alias("least"), F.first("n").alias("n"), F.first("root_cls").alias("root"))
    share = F.ceil((F.col("n") + F.col("least")) * up / (up + down))
    live = written(sized.select("cls", "root", "n", F.greatest(share, F.ceil(F.col("n") * up / down)).alias("need")), "able")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cls, held in zip(b.column("cls"), b.column("members"), strict=True):
                values = np.frombuffer(held.as_buffer(), np.int64)
                yield batch(shingle=pa.array(values), cls=pa.array(np.full(len(values), cls.as_py(), np.int64)))

    held = sets.join(live.select("cls"), "cls", "left_semi").select("cls", "members")
    entries = written(held.mapInArrow(unfold, "shingle long, cls long"), "entries")
    count = live.count()
    while count:
        now = entries.join(live.select("cls", "root"), "cls")
        common = now.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("shingle")
        enough = now.join(common, "shingle", "left_semi").groupBy("cls").agg(F.count("*").alias("common"))
        live = written(live.join(enough, "cls").filter("common >= need").drop("common"), "able")
        left = live.count()
        if left == count:
            break
        count = left
    return live, entries.join(live.select("cls", "root"), "cls")


def prefix_pairs(plain: DataFrame, classes: DataFrame, words: int, threshold: Fraction) -> DataFrame:
    """Pairs (a, b) that share a prefix shingle, a being a class with too few filled blocks."""
    up, down = threshold.numerator, threshold.denominator

    def prefixes(piece: Slice) -> pa.RecordBatch:
        hashes, first = shingle_sets(piece, words)
        size = np.diff(first)
        length = np.where(size > 0, size - (size * up + down - 1) // down + 1, 0)
        rows = owners(first)
        inside = np.arange(len(hashes)) - first[:-1][rows] < length[rows]
        return batch(shingle=signed(hashes[inside]), cls=signed(classes_of(hashes, first)[rows[inside]]))

    every = plain.mapInArrow(mapped(prefixes, "text", lower=True), "shingle long, cls long").distinct()
    some = every.join(classes.filter("few").select("cls"), "cls", "left_semi").select("shingle", F.col("cls").alias("a"))
    return some.join(every.withColumnRenamed("cls", "b"), "shingle").filter("a <> b").select("a", "b").distinct()


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """The documents whose id is the smallest of their component, with their columns.

    Of a component without ids the documents of one text stay.
    """
    id_, tag = unused(docs, "_id"), unused(docs, "_tag")
    every = linked(tagged(docs), words, threshold)
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("tag") == F.col("component_tag"))
    stay = every.filter(first).select(F.col("doc_id").alias(id_), F.col("tag").alias(tag)).distinct()
    own = F.col("doc_id").cast("long")
    same = own.eqNullSafe(F.col(id_)) & (F.when(own.isNull(), F.xxhash64("text")).otherwise(0) == F.col(tag))
    return docs.join(stay, same, "left_semi").select(docs.columns)
