"""Repeated strings: hot groups at every level, and rows that repeat ids or clash in columns."""

import random
from collections import Counter

import pytest

from assetspark.llm import repeats


def stays(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[s : s + length] for d in data for s in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                cover[s : s + length] = b"\1" * length
        out.append(bytes(x for x, c in zip(d, cover, strict=True) if not c).decode(errors="ignore"))
    return out


@pytest.mark.parametrize(("large", "huge"), [(2_000, 200_000), (20, 200_000), (20, 40), (0, 0)])
def test_one_line_in_most_documents(spark, monkeypatch, large, huge):
    monkeypatch.setattr(repeats, "LARGE", large)
    monkeypatch.setattr(repeats, "HUGE", huge)
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line = words(45)
    sides = [words(2) for _ in range(6)]
    texts = [words(20) + " " + rng.choice(sides) + " " + line[rng.randrange(20) :] + rng.choice(sides) + words(20) for _ in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in repeats.remove_repeats(docs).collect()}
    assert got == dict(enumerate(stays(texts)))


def test_rows_with_nulls_repeats_and_clashing_columns(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    part, other = words(60), words(70)
    texts = [None, "", "short", words(5) + part, part + words(5), other, other, words(80), words(9000) + part]
    ids = [1, 2, None, 4, 4, 5, 5, None, 9]
    rows = [(i, t, len(t or ""), "kept", k, "t", "spans") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _kept string, k int, t string, spans string").repartition(3)
    out = repeats.remove_repeats(docs)
    assert out.columns == docs.columns
    got = {r.k: r for r in out.collect()}
    assert [got[k].text or "" for k in range(len(texts))] == stays(texts) and got[0].text is None
    for r in got.values():
        assert r.n_chars == len(r.text or "") and (r["_kept"], r.t, r.spans) == ("kept", "t", "spans")
    assert repeats.remove_repeats(docs.limit(0)).count() == 0
