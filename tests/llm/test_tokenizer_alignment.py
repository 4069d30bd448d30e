"""Two tokenizers' ids side by side, against whole-text encoding and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vibralake.llm import queries
from vibralake.llm import tokenizer_alignment as ta
from vibralake.llm.texts import slices
from vibralake.llm.token_pieces import stretches

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, source string"
ODD = [
    None, "", " ", "  ", "\n", "a", "a ", " a", "a  b", "a   b  ", "It's 'so' and,so on.", "x<|endoftext|>y <s> </s> <unk> <0x41> z", "a▁b", "▁",
    "é é ﬁ İ", "a b　c\t d\r\ne", "日本語 のテキスト です", "🙂 🙃a 🙂🙂", "word " * 2000, "noblanks" * 500, "\x00 \x01a", "   " * 50,
]


def byte_map():
    return ta.byte_symbols()


def brute(texts):
    """Per text: (n_a, n_b, n_groups, n_links, n_best, count_sum, sha256) by the definition."""
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    symbols = byte_map()
    grouped = []
    for text in texts:
        groups = []
        if text:
            encoded, ids_b = a.encode(" " + text, add_special_tokens=False), b.encode(text)
            bytes_a = [bytes(symbols[c] for c in t) for t in encoded.tokens]
            pieces = [b.id_to_piece(i) for i in ids_b]
            bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces, strict=True)]
            whole = (" " + text).encode()
            if b"".join(bytes_a) == whole == b"".join(bytes_b):
                ends = []
                for parts in (bytes_a, bytes_b):
                    at, mine = 0, []
                    for p in parts:
                        at += len(p)
                        mine.append(at)
                    ends.append(mine)
                shared = sorted(set(ends[0]) & set(ends[1]))
                i = j = 0
                for cut in shared:
                    x, y = [], []
                    while i < len(ends[0]) and ends[0][i] <= cut:
                        x.append(encoded.ids[i])
                        i += 1
                    while j < len(ends[1]) and ends[1][j] <= cut:
                        y.append(ids_b[j])
                        j += 1
                    groups.append((x, y))
        grouped.append(groups)
    counts = Counter(p for groups in grouped for p in {(x, y) for g in groups for x in g[0] for y in g[1]})
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for groups in grouped:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((
            sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(counts[p] == top[p[0]] for p in links),
            sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    r = random.Random(8)
    signs = ["the", "of", "Anble", "tion,", " ", " ", " ", "  ", "\n", "\t", "é", "'s", "1990s", " ", "́", "-", "…", "<|endoftext|>", "<s>", "ß", "中", "🙂", "a.b", "(x)", "▁"]
    texts = ODD + ["".join(r.choice(signs[: r.choice([8, 24, 25])]) for _ in range(r.randint(1, 60))) for _ in range(300)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "the Of of", "s"), (None, "the Of of", "s"), (3, "of the", "s"), (3, "of the", "s")]
    table = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({c: F.lit(1) for c in ("block", "pairs", "pair", "documents", "groups", "place")})
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_tokenizer_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(row[0], *x) for row, x in zip(rows, brute([t for _, t, _ in rows]), strict=True)]
    assert sorted(map(str, (tuple(x) for x in got.collect()))) == sorted(map(str, want))


def test_equal_windows_have_one_number():
    both = ta.Aligner(ta.VOCABULARY_A, ta.VOCABULARY_B)
    keys = [b" and", b" onward", b"  and", b" and \tand", b" and"]
    parts = [both.of(keys)[k] for k in (0, 1)]
    data, bounds = np.frombuffer(b"".join(keys), np.uint8), np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    found = ta.Windows(both, *parts, data, bounds)
    of = [found.codes[a:b].tolist() for a, b in zip(found.first, found.first[1:])]
    assert of[0] == of[4] and len(of[0]) == 1 and of[0][0] in of[3]
    assert found.n == len(set(found.codes.tolist())) < len(found.codes)
    assert found.sizes[:, 0].sum() > 0 and (found.sizes[:, 3] >= found.sizes[:, 2]).all()
    assert len(found.text_bounds) == found.n + 1 and found.texts.tobytes().endswith(b";")


def test_many_small_blocks_and_a_forgetful_worker(spark, monkeypatch):
    texts = [f"word{i % 7} and other{i % 3} things" for i in range(60)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    monkeypatch.setattr(ta, "BLOCK_BYTES", 100)
    both = ta.Aligner(ta.VOCABULARY_A, ta.VOCABULARY_B)
    held = ta.blocks(spark.createDataFrame(rows, DOCS).repartition(4))
    assert held.count() >= 4
    known = ta.pair_counts(held)
    want = {i: x[:6] for i, x in enumerate(brute(texts))}
    for few in (ta.FEW_PAIRS, 3):  # pairs sent to all tasks, and pairs that come by a join
        got = {x.doc_id: (x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum) for x in ta.align(held, known, few).collect()}
        assert got == want
    monkeypatch.setattr(ta, "REMEMBERED", 1)
    both.of([b" a", b" b", b" c"])
    batch = pa.RecordBatch.from_arrays([pa.array([1, None]), pa.array([" a b a", None])], ["doc_id", "text"])
    row = ta.block_of(next(slices(iter([batch]), "text")), 0, both)
    assert len(both.known) == 2 and row["doc_id"] == [1, None] and row["windows"].tolist() == [0, 3, 3]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op12_tokenizer_alignment(spark, str(tmp_path)).collect() == []


def test_cut_texts_have_the_ids_of_whole_texts():
    both = ta.Aligner(ta.VOCABULARY_A, ta.VOCABULARY_B)
    assert both.marks
    r = random.Random(5)
    signs = [
        "the", "Re", "ó", "ß", "É", "ǅ", "ɏ", "ɐ", "Ω", "ж", "\u0301", "×", "÷", "²", "ª", "1", "20", ".", ",", "'", "'s", "'ll", "_", "-", "%%%", "<|endoftext|>",
        "<s>", "<0x0A>", "▁", " ", " ", " ", "  ", "\n", ".\n", "\r\n", "\t", "\x0b", "\x85", "\xa0", "\u3000", "\0", "中", "🙂",
    ]
    texts = ["é .", "é.", "×.", "é", "a.", ".", "don't.", "\u00e9 \n", "a\xa0 b", "é\xa0  b."] + ["".join(r.choices(signs, k=r.randint(1, 40))) for _ in range(3_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([" " + t for t in texts])], ["text"])
    for marks in (True, False):
        distinct, codes, firsts = stretches(next(slices(iter([batch]), "text")), marks=marks)
        sides = [(ids.tolist(), starts.tolist()) for ids, starts in both.of(distinct.to_pylist())]
        for i, text in enumerate(texts):
            mine = codes[firsts[i] : firsts[i + 1]].tolist()
            got = [[x for c in mine for x in ids[starts[c] : starts[c + 1]]] for ids, starts in sides]
            assert got == [both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)], (marks, text)


def test_words_are_tokenised_once_whatever_marks_follow():
    both = ta.Aligner(ta.VOCABULARY_A, ta.VOCABULARY_B)
    words, marks = ["nandeo", "quéren", "straße"], [".", ",", "***", "%%%", ".\nA"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["".join(f" {w}{m}" for w in words for m in marks), " é ó é ó"])], ["doc_id", "text"])
    row = ta.block_of(next(slices(iter([batch]), "text")), 0, both)
    assert set(both.known) == {f" {w}".encode() for w in [*words, "é", "ó"]} | {m.encode() for m in marks}
    assert row["windows"].tolist() == [0, 30, 34]
