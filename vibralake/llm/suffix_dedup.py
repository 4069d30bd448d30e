"""Removal of byte strings that occur more than once, by a sparse suffix array.

A string of ``LENGTH`` bytes is judged at an anchor inside it: of its first
``SPAN`` positions, the one whose next ``GRAM`` bytes have the smallest hash. Equal strings have their
anchors at the same place, and a string is repeated exactly if, seen from its anchor, some other anchor
matches far enough to the left and to the right. Only suffixes at anchors are sorted, some two in ``SPAN``.

1. Anchors are named by the bytes that any of their strings must share, ``LENGTH - SPAN + 1`` from the anchor on. Names
   that occur once cannot belong to a repeat and are dropped; sums combine before the shuffle.
2. What is left is dealt by name, in pieces of text that hold both contexts, and comes sorted by name. The suffixes
   at anchors of one name agree to the depth of the name; they are put in order by deep-shallow sorting: a column sort
   by eight bytes at a time (in place of multikey quicksort) to a shallow depth below the name, and blind tries for groups that still agree there. The left contexts
   are sorted in the same way, read backwards.
3. Both orders with their common prefix lengths give, for each anchor and each string through it, whether it occurs again.

Anchors with equal contexts on both sides are one row from the shuffle on, with a count. So many copies of a passage
cost one sorted suffix per task. A name with more than ``CROWD`` anchors, as of a line in many different documents, is not
sorted: its strings are counted by 128-bit digests, so that it does not gather in one task either.

Null text counts as empty. Documents with the same text as another are removed whole if long enough, and one of them stands for all.
Texts are told apart by their id, and by a hash where there is none or one id has several texts; so null and repeated ids change no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vibralake.llm.texts import U64, Rolling, Slice, mapped, mix, owners, signed
from vibralake.session import small_side, written

LENGTH = 200
SPAN = 100
GRAM = 12
SHALLOW = 24
# A name with more anchors than this is not sorted in one task; its strings are counted by digest.
CROWD = 20_000
BYTES = Rolling(41)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value in each window; the leftmost of equal ones."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(values)), 1

    def better(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return np.where(values[two] < values[one], two, one)

    while 2 * size <= width:
        at = better(at[: len(at) - size], at[size:])
        size *= 2
    return better(at[:n], at[width - size : width - size + n]) if size < width else at[:n]


def anchor_runs(piece: Slice, length: int, span: int, gram: int):
    """Row, anchor, first and last string start of each run of strings with one anchor; bytes as array places."""
    data, offsets = piece.data, piece.offsets
    if len(data) < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, np.zeros(1, U64)
    sums = BYTES.sums(BYTES.table[data])
    grams = np.arange(len(data) - gram + 1)
    at = window_minima(BYTES.of(sums, grams, grams + gram), span)
    n = len(data) - length + 1
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    fits = np.arange(n) + length <= offsets[1:][rows]
    start = np.flatnonzero(fits)
    at, row = at[start], rows[start]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    return row[first], at[first], start[first], start[last], sums


def rows_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def keys_of(matrix: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian 64-bit words, eight bytes to a column."""
    n, width = matrix.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = matrix
    return padded.view(">u8").astype(np.uint64)


class BlindTrie:
    """Orders strings with long common prefixes; branches know only where and by which byte they part.

    A string is sent down by the bytes at the branches' depths, whatever lies
    between; one comparison with the leaf it reaches gives the depth at which it
    really leaves, and there it is put in.
    """

    def __init__(self, strings: list[bytes], start: int):
        self.strings, self.start = strings, start
        self.root: list | int | None = None  # a leaf is a number, a branch [depth, {byte: child}, some leaf]
        self.same: dict[int, list[int]] = {}

    def add(self, i: int) -> None:
        text = self.strings[i]
        if self.root is None:
            self.root = i
            return
        node = self.root
        while isinstance(node, list):
            child = node[1].get(text[node[0]])
            node = node[2] if child is None else child
        other = self.strings[node]
        depth = common_prefix(text, other, self.start)
        if depth == len(text):
            self.same.setdefault(node, []).append(i)
            return
        parent, key, node = None, -1, self.root
        while isinstance(node, list) and node[0] < depth:
            parent, key = node, text[node[0]]
            node = node[1][key]
        if isinstance(node, list) and node[0] == depth:
            node[1][text[depth]] = i
            return
        branch = [depth, {text[depth]: i, other[depth]: node}, i]
        if parent is None:
            self.root = branch
        else:
            parent[1][key] = branch

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            elif node is not None:
                out.append(node)
                out.extend(self.same.get(node, ()))
        return out


def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of two strings of one length that agree before ``start``."""
    if a == b:
        return len(a)
    low, high = start, len(a)  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def deep_shallow(group: np.ndarray, matrix: np.ndarray, known: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order rows of bytes by group and content; and each row's common prefix with the one before (-1: another group).

    Rows of one group should agree in their first ``known`` bytes, which is checked. A column sort by eight bytes at a time covers ``shallow`` bytes; groups that
    are still together go to blind tries.
    """
    n, width = matrix.shape
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if known:
        by = np.argsort(group, kind="stable")
        same = group[by][1:] == group[by][:-1]
        if (matrix[by[1:], :known][same] != matrix[by[:-1], :known][same]).any():
            known = 0  # two strings of one name: compare from the start
    keys = keys_of(matrix[:, known : known + shallow])
    order = np.lexsort([*(keys[:, c] for c in range(keys.shape[1] - 1, -1, -1)), group])
    sorted_keys, sorted_group = keys[order], group[order]
    together = np.zeros(n, bool)
    together[1:] = (sorted_group[1:] == sorted_group[:-1]) & (sorted_keys[1:] == sorted_keys[:-1]).all(axis=1)
    edges = np.append(np.flatnonzero(~together), n)
    deep = min(width, known + shallow)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a == 2:
            one, two = matrix[order[a], deep:].tobytes(), matrix[order[a + 1], deep:].tobytes()
            if one > two:
                order[a], order[a + 1] = order[a + 1], order[a]
        elif b - a > 2:
            trie = BlindTrie([matrix[i].tobytes() for i in order[a:b]], deep)
            for i in range(b - a):
                trie.add(i)
            order[a:b] = order[a:b][trie.ordered()]
    prefix = np.full(n, -1, np.int64)
    differ = matrix[order[1:]] != matrix[order[:-1]]
    length = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    prefix[1:] = np.where(group[order[1:]] == group[order[:-1]], length, -1)
    return order, prefix


def repeated_strings(group: np.ndarray, right: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, several: np.ndarray, length: int, known: int) -> np.ndarray:
    """For each anchor row and left part l, whether the string of l bytes before and length - l after occurs again.

    ``right``: bytes from the anchor on; ``left``: bytes before it, backwards; both padded where the text ends. A row's strings have left
    parts from ``low`` to ``high``. ``several`` rows stand for more than one occurrence. Returns a matrix by l.
    """
    n, span = len(group), left.shape[1] + 1
    out = np.zeros((n, span), bool)
    if n == 0:
        return out
    forward, prefix = deep_shallow(group, right, known)
    backward, suffix = deep_shallow(group, left, 0)
    for part in range(span):
        here = (low <= part) & (part <= high)
        if not here.any():
            continue
        right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
        right_class[forward] = np.cumsum(prefix < length - part)
        left_class[backward] = np.cumsum(suffix < part)
        key = right_class[here] * (n + 1) + left_class[here]
        _, place, count = np.unique(key, return_inverse=True, return_counts=True)
        out[here, part] = (count[place] > 1) | several[here]
    return out


def spans_digest(data: bytes, covered: np.ndarray) -> tuple[int, int, str]:
    """Removed bytes, removed runs and SHA-256 of the rest."""
    runs = int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum())
    return int(covered.sum()), runs, hashlib.sha256(np.frombuffer(data, np.uint8)[~covered].tobytes()).hexdigest()


def own_ids(rows: DataFrame, several: DataFrame, hashed: Column) -> DataFrame:
    """Add doc_id, one for each text: the given id, or a negative hash of the text where there is none or ``several`` texts have it."""
    alone = F.col("given").isNotNull()
    if not several.isEmpty():
        rows = rows.join(small_side(several), F.col("given") == F.col("_given"), "left")
        alone = alone & F.col("_given").isNull()
    return rows.withColumn("doc_id", F.when(alone, F.col("given")).otherwise(hashed)).drop("_given")


def removed(docs: DataFrame, length: int = LENGTH, span: int = SPAN, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    known_bytes = length - span + 1
    content = F.coalesce(F.col("text"), F.lit(""))
    given = docs.select(F.col("doc_id").cast("long").alias("given"), content.alias("text"))
    hashed = F.xxhash64("text").bitwiseOR(F.lit(-(2**63)))
    described = given.select("given", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest"), hashed.alias("hashed"))
    known = written(described, "digests")
    texts_of = known.filter("given is not null").groupBy("given").agg(F.min("digest").alias("x"), F.max("digest").alias("y"))
    several = written(texts_of.filter("x <> y").select(F.col("given").alias("_given")), "several")
    known, plain = own_ids(known, several, F.col("hashed")), own_ids(given, several, hashed).select("doc_id", "text")
    first = written(known.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "first")

    def names(piece: Slice) -> pa.RecordBatch:
        row, at, _, _, sums = anchor_runs(piece, length, span, gram)
        name = BYTES.of(sums, at, at + known_bytes)
        order = np.lexsort((name, row))
        row, name = row[order], name[order]
        fresh = np.ones(len(name), bool)
        fresh[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(fresh)
        again = np.diff(np.append(first, len(name))) > 1
        return rows_of(name=signed(name[first]), doc_id=piece.rows.column("doc_id").take(pa.array(row[first])), again=pa.array(again))

    named = written(plain.mapInArrow(mapped(names, "text"), "name long, doc_id long, again boolean"), "names")
    often = named.groupBy("name").agg(F.count("*").alias("n"), F.max("again").alias("again"))
    # written, so that both sides of the join are plain exchanges, whose hot keys Spark splits
    shared = written(often.filter("n > 1 or again").select("name"), "shared")
    leaders = first.select(F.col("first_id").alias("doc_id")).filter("doc_id is not null").distinct()
    listed = named.select("name", "doc_id").join(shared, "name").groupBy("doc_id").agg(F.collect_set("name").alias("shared")).join(leaders, "doc_id", "left_semi")
    some = written(plain.join(listed, "doc_id").dropDuplicates(["doc_id"]), "candidates")

    def contexts(piece: Slice) -> pa.RecordBatch:
        row, at, low, high, sums = anchor_runs(piece, length, span, gram)
        name = BYTES.of(sums, at, at + known_bytes)
        lists = piece.rows.column("shared")
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        values = lists.flatten().to_numpy().view(U64)
        mine = np.isin(mix(name + mix(row.astype(U64))), mix(values + mix(owner.astype(U64))))
        row, at, low, high, name = row[mine], at[mine], low[mine], high[mine], name[mine]
        data, base = piece.data.tobytes(), piece.offsets[:-1][row]
        pieces = [data[a:b] for a, b in zip(low.tolist(), (high + length).tolist(), strict=True)]
        return rows_of(
            name=signed(name), before=pa.array((at - low).astype(np.int32)), after=pa.array((at - high).astype(np.int32)), piece=pa.array(pieces, pa.binary()),
            doc_id=piece.rows.column("doc_id").take(pa.array(row)), place=pa.array((low - base).astype(np.int64)),
        )

    schema = "name long, before int, after int, piece binary, doc_id long, place long"
    asked = written(some.mapInArrow(mapped(contexts, "text"), schema), "contexts")
    # equal pieces at equal anchors are one row to be sorted
    same = asked.groupBy("name", "before", "after", "piece").agg(F.count("*").alias("n"))
    crowded = written(asked.groupBy("name").agg(F.count("*").alias("anchors")).filter(F.col("anchors") > crowd).select("name"), "crowded")
    hot = not crowded.isEmpty()
    bounded = asked.join(crowded, "name", "left_anti").groupBy("name", "before", "after", "piece").agg(F.count("*").alias("n")) if hot else same
    dealt = bounded.repartition("name").sortWithinPartitions("name")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_names(batches):
            name = rows["name"].to_numpy()
            before, after = rows["before"].to_numpy().astype(np.int64), rows["after"].to_numpy().astype(np.int64)
            pieces = rows["piece"].to_pylist()
            n = len(pieces)
            right, left = np.zeros((n, length), np.uint8), np.zeros((n, span - 1), np.uint8)
            for i, (piece, b) in enumerate(zip(pieces, before.tolist(), strict=True)):
                whole = np.frombuffer(piece, np.uint8)
                tail, head = whole[b : b + length], whole[:b][::-1]
                right[i, : len(tail)], left[i, : len(head)] = tail, head
            found = repeated_strings(name, right, left, after, before, rows["n"].to_numpy() > 1, length, known_bytes)
            # bit k: the string that starts k bytes after the piece does
            some = np.flatnonzero(found.any(axis=1))
            bits = [np.packbits(found[i, after[i] : before[i] + 1][::-1]).tobytes() for i in some.tolist()]
            yield rows_of(
                name=pa.array(name[some]), before=pa.array(before[some].astype(np.int32)), after=pa.array(after[some].astype(np.int32)),
                piece=pa.array([pieces[i] for i in some.tolist()], pa.binary()), bits=pa.array(bits, pa.binary()),
            )

    judged = dealt.mapInArrow(judge, "name long, before int, after int, piece binary, bits binary")
    # the name is a hash of part of the piece with other values than this one
    key = ["name", "before", "after", F.xxhash64("piece").alias("digest")]
    decided = judged.select(*key, "bits")
    if hot:
        decided = decided.unionByName(counted_strings(asked.join(crowded, "name", "left_semi"), key, length))
    places = asked.select(*key, "doc_id", "place").join(decided, ["name", "before", "after", "digest"])
    gone = places.groupBy("doc_id").agg(F.collect_list(F.struct("place", "before", "after", "bits")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column("doc_id"), []
            for text, runs in zip(batch.column("text"), batch.column("runs"), strict=True):
                data = text.as_py().encode()
                change = np.zeros(len(data) + 1, np.int64)
                for run in runs.as_py():
                    marks = np.unpackbits(np.frombuffer(run["bits"], np.uint8))[: run["before"] - run["after"] + 1]
                    start = run["place"] + np.flatnonzero(marks)
                    change[start] += 1
                    change[start + length] -= 1
                out.append(spans_digest(data, np.cumsum(change[:-1]) > 0))
            n, runs, sha = zip(*out, strict=True) if out else ((), (), ())
            yield rows_of(_id=ids, n_removed=pa.array(n, pa.int64()), n_spans=pa.array(runs, pa.int64()), kept=pa.array(sha, pa.string()))

    texts = some.select("doc_id", "text").join(gone, "doc_id")
    parts = texts.mapInArrow(cut, "_id long, n_removed long, n_spans long, kept string")
    rows = known.join(first, "digest").join(parts, F.col("doc_id") == F.col("_id"), "left")
    rows = rows.drop("doc_id").withColumnRenamed("given", "doc_id")
    copy = (F.col("n_bytes") >= length) & (F.col("copies") > 1)
    none = F.lit(0).cast("long")
    return rows.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "digest")).alias("kept_sha256"),
    )


def counted_strings(asked: DataFrame, key: list, length: int) -> DataFrame:
    """(name, before, after, digest, bits) of anchors with repeated strings, found by counting digests of the strings.

    For names of any number of anchors: counts combine before the shuffle, and no task holds a name. Anchors with equal
    pieces are one row with a count first.
    """

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                shares, made, starts = [], [], []
                for i, piece in enumerate(part.column("piece").to_pylist()):
                    for k in range(len(piece) - length + 1):
                        shares.append(i)
                        starts.append(k)
                        made.append(hashlib.blake2b(piece[k : k + length], digest_size=16).digest())
                take = pa.array(shares, pa.int64())
                columns = {c: part.column(c).take(take) for c in ("name", "before", "after", "digest", "n")}
                yield rows_of(**columns, start=pa.array(starts, pa.int32()), string=pa.array(made, pa.binary()))

    same = asked.groupBy("name", "before", "after", "piece").agg(F.count("*").alias("n")).select(*key, "piece", "n")
    schema = "name long, before int, after int, digest long, n long, start int, string binary"
    # written, so that both sides of the join are plain exchanges, whose hot keys Spark splits
    every = written(same.mapInArrow(strings, schema), "strings")
    again = written(every.groupBy("string").agg(F.sum("n").alias("times")).filter("times > 1").select("string"), "again")
    found = every.join(again, "string").groupBy("name", "before", "after", "digest").agg(F.collect_list("start").alias("starts"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for before, after, starts in zip(*(batch.column(c).to_pylist() for c in ("before", "after", "starts")), strict=True):
                marks = np.zeros(before - after + 1, np.uint8)
                marks[starts] = 1
                bits.append(np.packbits(marks).tobytes())
            yield rows_of(**{c: batch.column(c) for c in ("name", "before", "after", "digest")}, bits=pa.array(bits, pa.binary()))

    return found.mapInArrow(packed, "name long, before int, after int, digest long, bits binary")


def whole_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by name, cut anew so that a name is never split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        name = batch.column("name").to_numpy()
        last = int(np.searchsorted(name, name[-1]))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
