"""Inverted lists in impact order, by shard, with a maximum per block.

A shard holds some megabytes of texts: its vocabulary, the terms of every item (to score one in full), and per term the
items that have it, by falling impact, cut into blocks whose greatest impact is known. The impact of a term in an item is its
share of the item's vector of unit length, so a score is the sum of a query's shares times impacts.

For the best k items of a query the first blocks of its strongest terms are scored in full, which gives a k-th score to beat. A block then matters only if
its maximum times the query's share is a set part of that score; the blocks below are skipped, and the maxima of the first ones
skipped bound what an item can have in them all together. The other blocks are added up. Items whose sum and that bound
do not reach the k-th score are done with, and the few that are left are scored in full. The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Items of a block.
BLOCK = 64
# Terms whose first blocks are scored beforehand.
FIRST_TERMS = 8
# What is skipped adds up to one part of so many of the score to beat, at most.
SKIPPED = 1.5
SCORE_DIGITS = 9
# More than rounding can move a score.
SLACK = 2e-9


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from each start to its end, and where each run begins among them."""
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(starts - first[:-1], sizes) + np.arange(first[-1]), first


def counted(keys: pa.Array, groups: pa.Array, words: pa.Array) -> dict:
    """A raw shard: items, their distinct terms with counts, the vocabulary and in how many items each term is."""
    encoded = words.flatten().dictionary_encode()
    vocabulary, codes = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    item = np.repeat(np.arange(len(keys)), lengths)
    width = max(1, len(vocabulary))
    once, tf = np.unique(item * width + codes, return_counts=True)
    of, term = np.divmod(once, width)
    return {
        "keys": keys, "groups": groups, "vocabulary": vocabulary,
        "df": pa.array(np.bincount(term, minlength=len(vocabulary)).astype(np.int32)),
        "bounds": np.searchsorted(of, np.arange(len(keys) + 1)).astype(np.int64).tobytes(),
        "term": term.astype(np.int32).tobytes(), "tf": tf.astype(np.int32).tobytes(),
    }


def weighed(raw: dict, idf: np.ndarray, order: np.ndarray | None = None) -> dict:
    """The searchable shard: impacts per item, and per term the items by falling impact with the maximum of each block.

    Only ``order`` takes long to find; a stored shard has it, and the rest is worked out when the shard is opened.
    """
    bounds, term = np.frombuffer(raw["bounds"], np.int64), np.frombuffer(raw["term"], np.int32)
    weight = np.frombuffer(raw["tf"], np.int32) * idf[term]
    item = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    norm = np.sqrt(np.bincount(item, weight * weight, minlength=len(bounds) - 1))
    impact = weight / np.where(norm > 0, norm, 1.0)[item]
    kept = np.lexsort((item, -impact, term)) if order is None else order
    kept = kept[impact[kept] > 0]
    lists = np.searchsorted(term[kept], np.arange(len(idf) + 1))
    blocks = -(-np.diff(lists) // BLOCK)
    block_bounds = np.concatenate([[0], np.cumsum(blocks)])
    of = np.repeat(np.arange(len(blocks)), blocks)
    heads = lists[of] + (np.arange(block_bounds[-1]) - block_bounds[of]) * BLOCK
    return {
        "order": kept.astype(np.int32).tobytes(),
        "bounds": raw["bounds"], "term": raw["term"], "impact": impact.tobytes(),
        "lists": lists.astype(np.int64).tobytes(), "posted": item[kept].astype(np.int32).tobytes(), "posted_impact": impact[kept].tobytes(),
        "block_bounds": block_bounds.astype(np.int64).tobytes(), "block_max": impact[kept][heads].tobytes(),
    }


class Shard:
    """One shard, open for queries."""

    def __init__(self, row: dict):
        self.keys: pa.Array = row["keys"].values
        groups = row["groups"].values.dictionary_encode()
        self.names = {name: code for code, name in enumerate(groups.dictionary.to_pylist())}
        self.group = pc.fill_null(groups.indices, -1).to_numpy(zero_copy_only=False)
        self.vocabulary: pa.Array = row["vocabulary"].values
        made = weighed({n: row[n].as_py() for n in ("bounds", "term", "tf")}, *(np.frombuffer(row[n].as_py(), STORED[n]) for n in ("idf", "order")))
        numbers = {n: np.frombuffer(made[n], t) for n, t in NUMBERS.items()}
        self.bounds, self.term, self.impact = numbers["bounds"], numbers["term"], numbers["impact"]
        self.lists, self.posted, self.posted_impact = numbers["lists"], numbers["posted"], numbers["posted_impact"]
        self.block_bounds, self.block_max = numbers["block_bounds"], numbers["block_max"]
        self.weights = np.zeros(len(self.vocabulary) + 1)
        order = pc.sort_indices(self.keys).to_numpy()  # ties go to the lower key
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))

    def known(self, terms: pa.Array) -> np.ndarray:
        """Number of each term in this shard, -1 where it has none."""
        return pc.fill_null(pc.index_in(terms, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)

    def scores(self, items: np.ndarray) -> np.ndarray:
        """Full scores under the query in ``weights``."""
        places, starts = ranges(self.bounds[items], self.bounds[items + 1])
        share = self.weights[self.term[places]] * self.impact[places]
        return np.round(np.add.reduceat(share, starts[:-1]), SCORE_DIGITS) if len(items) else np.zeros(0)

    def best(self, terms: np.ndarray, shares: np.ndarray, wanted: str | None, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Items and scores of the best ``k`` above zero, the postings read and those that the terms have."""
        have = terms >= 0
        terms, shares = terms[have], shares[have]
        listed = self.lists[terms + 1] - self.lists[terms]
        terms, shares, listed = terms[listed > 0], shares[listed > 0], listed[listed > 0]
        postings = int(listed.sum())
        code = self.names.get(wanted, -2) if wanted is not None else None
        if not len(terms) or code == -2:
            return np.zeros(0, np.int64), np.zeros(0), 0, postings
        self.weights[terms] = shares
        first, last = self.lists[terms], self.lists[terms + 1]
        strongest = np.argsort(-shares * self.block_max[self.block_bounds[terms]], kind="stable")[:FIRST_TERMS]
        places, _ = ranges(first[strongest], np.minimum(first[strongest] + BLOCK, last[strongest]))
        seeds = np.unique(self.posted[places])
        seeds = seeds if code is None else seeds[self.group[seeds] == code]
        bar = kth(self.scores(seeds), k)

        blocks, runs = ranges(self.block_bounds[terms], self.block_bounds[terms + 1])
        greatest = self.block_max[blocks] * np.repeat(shares, np.diff(runs))
        needed = np.add.reduceat(greatest >= bar / (SKIPPED * len(terms)), runs[:-1], dtype=np.int64)
        skipped = np.where(needed < np.diff(runs), greatest[np.minimum(runs[:-1] + needed, runs[1:] - 1)], 0.0).sum()
        places, runs = ranges(first, np.minimum(first + needed * BLOCK, last))
        held = np.bincount(self.posted[places], self.posted_impact[places] * np.repeat(shares, np.diff(runs)), minlength=len(self.keys))
        if code is not None:
            held[self.group != code] = 0.0
        bar = max(bar, kth(held[held > 0], k))
        found = np.flatnonzero((held > 0) & (held >= bar - skipped - SLACK))
        scores = self.scores(found)
        self.weights[terms] = 0.0
        kept = np.lexsort((self.place[found], -scores))[:k]
        found, scores = found[kept], scores[kept]
        above = scores > 0
        return found[above], scores[above], len(places) + int(np.minimum(BLOCK, last[strongest] - first[strongest]).sum()), postings


def kth(scores: np.ndarray, k: int) -> float:
    """The k-th greatest score, 0 where there are fewer."""
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0.0


NUMBERS = {
    "bounds": np.int64, "term": np.int32, "impact": np.float64, "lists": np.int64, "posted": np.int32, "posted_impact": np.float64,
    "block_bounds": np.int64, "block_max": np.float64,
}
# What a stored shard has; the rest follows from it.
STORED = {"bounds": np.int64, "term": np.int32, "tf": np.int32, "idf": np.float64, "order": np.int32}


def answers(shards: Iterator[dict], asked: pa.Table, k: int, costs: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The best ``k`` items of each asked query in each shard; with ``costs`` what it read instead."""
    if not asked.num_rows:
        return
    terms, shares = asked["terms"].combine_chunks(), asked["shares"].combine_chunks()
    flat, bounds = terms.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))])
    weights = shares.flatten().to_numpy(zero_copy_only=False)
    wanted, ids = asked["wanted"].to_pylist(), asked["query_id"].combine_chunks()
    for row in shards:
        shard = Shard(row)
        known = shard.known(flat)
        queries, items, scores, read = [], [], [], []
        for q, name in enumerate(wanted):
            a, b = bounds[q], bounds[q + 1]
            found, score, n, postings = shard.best(known[a:b], weights[a:b], name, k)
            queries.append(np.full(len(found), q))
            items.append(found)
            scores.append(score)
            read.append((n, postings))
        if costs:
            table = np.array(read, np.int64).reshape(-1, 2)
            columns = [ids, pa.array(table[:, 0]), pa.array(table[:, 1])]
        else:
            columns = [ids.take(pa.array(np.concatenate(queries))), shard.keys.take(pa.array(np.concatenate(items))), pa.array(np.concatenate(scores))]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
