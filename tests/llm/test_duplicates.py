"""Exact, near, substring and word-run duplicates against brute force on small fixtures."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from vibralake.llm import exact_dedup, ngram_join, recompression, suffix_dedup
from vibralake.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts):
    """A table like documents with columns whose names clash with those that operators use inside."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("key", "norm", "size", "name", "cls", "bucket", "n", "kept", "_id")})


def mixed_texts(seed=3):
    """Nulls, empties, long texts, copies, near copies, shared passages, runs of one word, ties."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefé") for _ in range(r.randint(1, 7))) for _ in range(300)]

    def prose(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    passage, base = prose(80), prose(120)
    out = [None, "", "   ", "\n\t", "one", "One", "two words", "ÄÖ äö", "a" * 450, "a" * 1203, "ab " * 200, "x y z w", "x y z w"]
    out += [prose(30), base, base, base.upper(), base + " ", prose(60) + " " + passage + " " + prose(20), passage, prose(7) + "\n" + passage]
    for _ in range(12):  # near copies in a chain of edits
        words = base.split(" ")
        for _ in range(r.randint(1, 5)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        base = " ".join(words)
        out.append(base)
    out += ["the " * 170, "the " * 60 + prose(50), prose(3000), prose(55) + " " + passage[:230]]
    return [(i * 3 % 101, t) for i, t in enumerate(out)]


def words(text):
    return WORD.findall(text or "")


def test_exact_groups_and_forced_collisions(spark):
    texts = mixed_texts()
    table = docs(spark, texts)
    plain = {i: (t or "").translate(UPPER) for i, t in texts}
    for bits in (64, 3):
        index = exact_dedup.build(table, capacity=4, bits=bits)
        got = {r.doc_id: r for r in exact_dedup.lookup(table, index, bits).collect()}
        for i, t in plain.items():
            group = [j for j, u in plain.items() if u == t]
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(group), len(group), i == max(group))
            assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert index.directory.agg(F.sum("held")).first()[0] == len(set(plain.values()))
        if bits == 3:
            assert max(r.chain for r in got.values()) > 0
        else:
            assert index.directory.agg(F.max("depth")).first()[0] >= 2
            assert index.directory.agg(F.max("held")).first()[0] <= 4


def test_exact_survivors_keep_columns_and_single_rows(spark):
    table = docs(spark, [(1, "a"), (1, "a"), (2, "A"), (None, "q"), (None, None), (5, "")])
    kept = exact_dedup.survivors(table)
    assert kept.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, "A"), (None, "q"), (5, "")], key=str)
    assert exact_dedup.deduplicate(table.limit(0)).count() == 0


def brute_components(texts, k=4):
    sets = {}
    for i, t in texts:
        w = words((t or "").translate(UPPER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("slack", [ngram_join.SLACK, -1])
def test_ngram_components(spark, slack):
    """With slack -1 every set falls to the prefix join."""
    texts = mixed_texts(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs(spark, texts), slack=slack).collect()}
    assert got == brute_components(texts)


def test_ngram_many_near_copies(spark):
    r = random.Random(1)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    texts = []
    for i in range(160):
        edited = list(base)
        for _ in range(r.randint(0, 6)):
            edited[r.randrange(len(edited))] = f"e{r.randrange(9999)}"
        texts.append((i, " ".join(edited)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.link(docs(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_ngram_empty_table_and_columns(spark):
    table = docs(spark, [(3, "a b c d"), (1, "A b c d"), (2, None)])
    assert ngram_join.link(table.limit(0)).count() == 0
    kept = ngram_join.one_of_each(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, j) for j in range(101, 140)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {j: 100 for j in range(101, 140)}


def brute_bytes(texts, length):
    where = {}
    data = [(i, (t or "").encode()) for i, t in texts]
    for n, (_, b) in enumerate(data):
        for p in range(len(b) - length + 1):
            where.setdefault(b[p : p + length], []).append((n, p))
    covered = [bytearray(len(b)) for _, b in data]
    for places in where.values():
        if len(places) > 1:
            for n, p in places:
                covered[n][p : p + length] = b"\1" * length
    out = {}
    for (i, b), c in zip(data, covered, strict=True):
        kept = bytes(x for x, gone in zip(b, c, strict=True) if not gone)
        runs = len(re.findall(rb"\x01+", bytes(c)))
        out[i] = (len(b), sum(c), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length,span,gram", [(200, 100, 12), (24, 10, 4)])
def test_repeated_bytes(spark, length, span, gram):
    texts = mixed_texts(7)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removed(docs(spark, texts), length, span, gram).collect()}
    assert got == brute_bytes(texts, length)


def test_repeated_bytes_of_no_rows(spark):
    assert suffix_dedup.removed(docs(spark, []), 200).count() == 0


def brute_words(texts, window):
    where = {}
    split = {i: words(t) for i, t in texts}
    for i, w in split.items():
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            where[key] = min(where.get(key, i), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if where[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("window,rounds", [(50, 4), (50, 8), (12, 2), (3, 1)])
def test_repeated_words(spark, window, rounds):
    texts = mixed_texts(9)
    got = {r.doc_id: tuple(r)[1:] for r in recompression.removed(docs(spark, texts), window, rounds).collect()}
    assert got == brute_words(texts, window)


def test_repeated_words_of_rows_with_one_id_and_of_none(spark):
    text = " ".join(f"w{i}" for i in range(70))
    table = docs(spark, [(4, text), (4, text), (9, "z " + text), (None, text)])
    got = sorted((str(r.doc_id), r.n_removed) for r in recompression.removed(table).collect())
    assert got == [("4", 0), ("4", 0), ("9", 70), ("None", 0)]
    assert recompression.removed(table.limit(0)).count() == 0


def twins():
    """Two words of 1,024 letters that are opposite everywhere, and whose sums of powers meet for every odd base modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_sums_of_powers_confuse(spark):
    one, other = twins()
    tail = " ".join(f"w{i}" for i in range(60))
    got = {x.doc_id: x.component_id for x in ngram_join.link(docs(spark, [(1, one), (2, other), (3, one)])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    removed = {x.doc_id: (x.n_words, x.n_removed) for x in recompression.removed(docs(spark, [(1, f"{one} {tail}"), (2, f"{other} {tail}")])).collect()}
    assert removed == {1: (61, 0), 2: (61, 60)}


def test_near_copies_without_ids_and_with_one_id(spark):
    base = [f"w{i}" for i in range(120)]
    near, far = " ".join(base[:60] + ["x"] + base[61:]), " ".join(f"q{i}" for i in range(80))
    texts = [(None, " ".join(base)), (None, near), (None, far), (9, "alone in the world"), (9, far + " more")]
    kept = sorted(x.text for x in ngram_join.one_of_each(docs(spark, texts)).collect())
    assert len(kept) == 3 and "alone in the world" in kept and far + " more" in kept and (near in kept) != (" ".join(base) in kept)
    linked = ngram_join.link(docs(spark, texts)).collect()
    assert sorted(str((x.doc_id, x.component_id)) for x in linked) == sorted(map(str, [(None, None), (None, None), (None, 9), (9, 9), (9, 9)]))
    copies = [(5, near), (None, " ".join(base)), (3, far), (3, " ".join(base) + " end")]
    found = {(x.doc_id, x.n_shingles): x.component_id for x in ngram_join.link(docs(spark, copies)).collect()}
    assert found[5, 117] == 3 and found[None, 117] == 3 and found[3, 118] == 3


def test_repeats_of_texts_without_an_id_or_with_one_id(spark):
    r = random.Random(6)
    passage, *rest = ["".join(r.choice("abcdefgh ") for _ in range(260)) for _ in range(6)]
    for texts in (
        [(None, rest[0] + passage), (1, passage + rest[1]), (2, rest[2])],
        [(7, rest[0] + passage), (7, rest[1]), (1, passage + rest[2]), (7, rest[3] + passage), (None, rest[4])],
    ):
        got = {(x.doc_id, x.kept_sha256): (x.n_removed, x.n_spans) for x in suffix_dedup.removed(docs(spark, texts)).collect()}
        want = {}
        for i, t in texts:
            left = t.replace(passage, "")
            want[i, hashlib.sha256(left.encode()).hexdigest()] = (len(t) - len(left), int(left != t))
        assert got == want
