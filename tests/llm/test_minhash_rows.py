"""MinHash: pruning, groups larger than a block, and rows judged by id and text."""

import random
from collections import Counter

import numpy as np
import pytest

from assetspark.llm import minhash


def links(sets):
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in sets}


def shingled(text):
    w = minhash.words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("n", [50, 200, 500, 1000, 2000, 5000])
def test_disjoint_sets_do_not_survive(n):
    rng = np.random.default_rng(n)
    a, b = (minhash.signature(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in range(2))
    low = lambda x: (x & np.uint64(0xFF)).astype(np.uint8)[None, :]
    assert not minhash.survives(low(a), low(b))[0] and minhash.survives(low(a), low(a))[0]


def test_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "SET_BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    texts = []
    for k in range(150):
        words = list(base)
        for at in rng.sample(range(100), rng.choice([0, 1, 1, 2, 3])):
            words[at] = f"x{rng.randrange(60)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    want = links({k: shingled(t) for k, t in enumerate(texts)})
    assert len(set(want.values())) > 3 and got == want


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(f"v{rng.randrange(9999)}" for _ in range(n))
    t, u, alone = words(80), words(80), words(60)
    rows = [(1, t, "a"), (5, t, "b"), (5, u, "c"), (7, u + " end", "d"), (9, alone, "e"), (9, alone, "f"), (None, t, "g"), (None, u + " other", "h"), (11, None, "i"), (11, None, "j"), (None, "", "k"), (12, "  ", "l")]
    docs = spark.createDataFrame([(i, x, z, k) for k, (i, x, z) in enumerate(rows)], "doc_id long, text string, label string, text_hash int")
    out = minhash.deduplicate(docs)
    assert out.columns == docs.columns
    stays = Counter((r.doc_id, r.text) for r in out.collect())
    assert stays == Counter([(1, t), (5, u), (9, alone), (11, None), (11, None), (None, ""), (12, "  ")])
    assert minhash.deduplicate(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        minhash.deduplicate(docs.withColumnRenamed("label", "_near_id"))
    by_row = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert by_row[(None, 1, False)] == 1 and by_row[(None, 5, False)] == 1 and by_row[(None, None, True)] == 1
