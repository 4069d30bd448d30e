"""The pipeline's stage of near copies against brute force: five words, similarity of 0.80."""

import random

import corpus_pipeline
from tests.llm.test_duplicates import UPPER, docs, mixed_texts, words

K = 5


def shingles(text):
    w = words((text or "").translate(UPPER))
    return {tuple(w[j : j + K]) for j in range(len(w) - K + 1)} if len(w) >= K else ({tuple(w)} if w else set())


def similarity(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def brute_kept(texts):
    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(i for i in sets if find(i) == i)


def test_near_stage_removes_copies_from_080_on(spark):
    r = random.Random(4)
    texts = mixed_texts(13)
    ids = iter(range(1000, 2000))
    between = below = 0
    for added in range(15, 32):  # the same document with new text at its end
        base = [f"w{r.randrange(10**6)}" for _ in range(r.choice((104, 504)))]
        longer = base + [f"n{r.randrange(10**6)}" for _ in range((len(base) - K + 1) * added // 100)]
        pair = [(next(ids), " ".join(base)), (next(ids), " ".join(longer))]
        s = similarity(*(shingles(t) for _, t in pair))
        between, below = between + (0.80 <= s < 0.85), below + (s < 0.80)
        texts += pair
    for changed in range(1, 9):  # and with some of its words changed
        base = [f"w{r.randrange(10**6)}" for _ in range(200)]
        edited = list(base)
        for at in r.sample(range(20, 180, 7), changed):
            edited[at] = f"e{r.randrange(10**6)}"
        pair = [(next(ids), " ".join(base)), (next(ids), " ".join(edited))]
        s = similarity(*(shingles(t) for _, t in pair))
        between, below = between + (0.80 <= s < 0.85), below + (s < 0.80)
        texts += pair
    assert between >= 5 and below >= 5
    table = docs(spark, texts)
    kept = corpus_pipeline.near_stage(spark, table, None)
    assert kept.columns == table.columns
    assert sorted(x.doc_id for x in kept.collect()) == brute_kept(texts)
