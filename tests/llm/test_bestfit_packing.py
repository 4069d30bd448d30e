"""Packing by residual vectors: ids against whole-text encoding, seats against placing one piece after another."""

import functools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vibralake.llm import bestfit_packing as bp
from vibralake.llm import queries

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, source string"
ODD = [
    None, "", " ", "\n\n", "a", "It's 'same' and,so  on.", "x<|endoftext|>y <|endoftext|> z", "<|ENDOFTEXT|>", "É é é ́a",
    "İI ΣΑΣ ﬁ", "a b　c\t d\r\ne", "日本語 のテキスト です", "🙂 🙃a 🙂🙂", "word " * 3000, "no-blanks" * 900, "a' s 's don't won'tt",
]


@functools.cache
def vocabulary():
    import public_tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def brute_ids(text):
    return [*vocabulary().encode(text or "", add_special_tokens=False).ids, 0]


def one_after_another(lengths, capacity, rule):
    """Rooms by sequence, placing pieces singly by falling length; and the pieces of each."""
    rooms, held = [], []
    whole = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n])
        best = None
        for k, room in enumerate(rooms):
            if (room >= need).all():
                left = (room - need) / whole if rule == "norm" else None
                score = float((left**2 * capacity.weights).sum()) if rule == "norm" else float(((room / whole) * (need / whole) * capacity.weights).sum())
                if best is None or score < best[0]:
                    best = (score, k)
        if best is None:
            rooms.append(np.array([capacity.tokens, capacity.documents, capacity.attention]))
            held.append([])
            best = (0, len(rooms) - 1)
        rooms[best[1]] = rooms[best[1]] - need
        held[best[1]].append(n)
    return held


def seats(runs, histogram):
    """The pieces of each sequence as the runs tell."""
    out = [[] for _ in range(runs.sequences)]
    lengths = [n for n in sorted(histogram) for _ in range(histogram[n])]
    for place, n in enumerate(lengths):
        run = int(np.searchsorted(runs.start, place, "right")) - 1
        assert runs.length[run] == n
        within = place - runs.start[run]
        out[int(runs.sequence[run] + within // runs.each[run])].append((int(runs.offset[run] + within % runs.each[run] * n), n))
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(64, 64, 64 * 64), (64, 5, 64 * 64), (64, 9, 1600), (100, 7, 10_000)])
def test_runs_equal_placing_singly(rule, limits):
    r = random.Random(str(limits))
    for trial in range(6):
        capacity = bp.Capacity(*limits, weights=(1.0, 0.5 * trial, 0.25))
        most = min(limits[0], int(limits[2] ** 0.5))
        lengths = [min(most, 1 + int(r.expovariate(1 / (4 + 6 * trial)))) for _ in range(r.randint(1, 300))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        runs = bp.best_fit(histogram, capacity, rule)
        got = seats(runs, histogram)
        want = one_after_another(lengths, capacity, rule)
        assert [sorted(n for _, n in x) for x in got] == [sorted(x) for x in want]
        for x in got:
            place = 0
            for offset, n in sorted(x):
                assert offset == place
                place += n
            assert place <= limits[0] and len(x) <= limits[1] and sum(n * n for _, n in x) <= limits[2]


def test_hot_lengths_take_few_runs():
    runs = bp.best_fit({2048: 10**9, 700: 10**9, 648: 10**9, 1: 10**10}, bp.Capacity())
    assert len(runs.start) < 20
    assert runs.sequences >= -(-(10**9 * 3396 + 10**10) // 2048)
    with pytest.raises(ValueError):
        bp.best_fit({65: 1}, bp.Capacity(64, 64, 4096))
    with pytest.raises(ValueError):
        bp.best_fit({60: 1}, bp.Capacity(64, 64, 3000))


def test_ids_equal_whole_texts(spark):
    r = random.Random(3)
    signs = ["the", "Of", "and,", " ", "  ", "\n", "\t", "é", "'s", "'ll", "1990s", " ", "́", "-", "…", "<|endoftext|>", "ß", "中", "🙂", "\x1c", "a.b"]
    texts = ODD + ["".join(r.choice(signs) for _ in range(r.randint(1, 40))) for _ in range(300)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    found = {}
    for x in bp.pieces(spark.createDataFrame(rows, DOCS).repartition(3), window=64).collect():
        found.setdefault(x.doc_id, []).append(x)
    for i, t in enumerate(texts):
        ids = brute_ids(t)
        cut = sorted(found[i], key=lambda x: x.piece)
        assert [y for x in cut for y in np.frombuffer(x.ids, "<u4").tolist()] == ids
        assert [(x.piece, x.start, x.length) for x in cut] == [(k, 64 * k, min(64, len(ids) - 64 * k)) for k in range(-(-len(ids) // 64))]


def test_query_packs_every_piece(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(100 + i, "w " * int(r.expovariate(1 / 300)), "h") for i in range(400)]
    rows += [(None, "same", "h")] * 200 + [(5, "again", "h")] * 3
    table = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("row", "tie", "place", "length", "piece", "offset", "_id")})
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_bestfit_packing(spark, str(tmp_path)).collect()
    want = []
    for i, t, _ in rows:
        ids = brute_ids(t)
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want.append((str(i), k // 2048, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in got) == sorted(want)
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for held in by.values():
        place = 0
        for offset, n in sorted(held):
            assert offset == place
            place += n
        assert place <= 2048
    assert len(by) == len(one_after_another([x.length for x in got], bp.Capacity(), "norm"))
    assert len(by) <= -(-sum(x.length for x in got) // 2048) + 1


def test_sequences_hold_their_pieces_tokens(spark):
    rows = [(i, "one two " * (i % 40), "s") for i in range(120)]
    packed = bp.pack(bp.pieces(spark.createDataFrame(rows, DOCS), window=50), bp.Capacity(50, 4, 2500))
    made = {x.sequence_id: x for x in bp.sequences(packed).collect()}
    for x in packed.collect():
        assert made[x.sequence_id].ids[4 * x.offset : 4 * (x.offset + x.length)] == x.ids
    assert all(x.n_tokens <= 50 and x.n_documents <= 4 for x in made.values())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_bestfit_packing(spark, str(tmp_path)).collect() == []
