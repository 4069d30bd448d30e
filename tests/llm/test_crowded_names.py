"""Names with many different contexts: counted by digest, never held by one task."""

import os
import random

import pytest

from tests.llm.test_duplicates import brute_bytes, docs, mixed_texts
from vibralake.llm import suffix_dedup


@pytest.mark.parametrize("crowd", [5, 10**6])
def test_crowded_names_are_counted_and_not_sorted(spark, monkeypatch, tmp_path, crowd):
    r = random.Random(8)
    line = "".join(r.choice("abcdef ") for _ in range(190))  # in every document, with other text around it
    own = lambda: "".join(r.choice("ghijkl ") for _ in range(150))
    texts = mixed_texts(7) + [(200 + i, own() + line + "and so it goes on " * (i % 2) + own()) for i in range(40)]
    log, plain = str(tmp_path / "sizes"), suffix_dedup.repeated_strings

    def noted(group, *rest):
        with open(log, "a") as f:
            f.write("".join(f"{list(group).count(g)}\n" for g in set(group.tolist())))
        return plain(group, *rest)

    monkeypatch.setattr(suffix_dedup, "repeated_strings", noted)
    got = {x.doc_id: tuple(x)[1:] for x in suffix_dedup.removed(docs(spark, texts), crowd=crowd).collect()}
    assert got == brute_bytes(texts, 200)
    assert os.path.exists(log)
    largest = max(int(n) for n in open(log))
    assert largest <= 5 if crowd == 5 else largest > 5
