"""The registered queries on a small folder: every digest column against its contract."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from assetspark.llm import registry


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(17)
    words = lambda n: " ".join("".join(rng.choices("abcdeéñ日🙂-'", k=rng.randint(1, 8))) for _ in range(n))
    base = words(90)
    out = [None, "", " \n\t ", "½²Ⅷ①", "one", base, base, base + " end", "x" * 900, words(2500)]
    out += [words(rng.randint(1, 120)) for _ in range(30)]
    out += [words(30) + "\n" + base[40:340] + "\n" + words(20) for _ in range(4)]
    out += ["password = hunter22! token:'abc' AKIA" + "Z9" * 10 + " " + "0a" * 14, 'api_key="é🙂" API-KEY apikey: sesame_street AKIA123']
    return list(enumerate(out))


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("queries"))
    rng = random.Random(1)
    docs = [(k, t, ("xx", "yy", None)[k % 3], "s", 0) for k, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    vectors = [(k, [rng.gauss(0, 1) for _ in range(8)], k % 3) for k in range(40)] + [(90, None, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{top}/embeddings.parquet")
    spark.createDataFrame([(1, "u", "<html><body><p>Text &amp; more.</p></body></html>"), (2, "v", None)], "page_id long, url string, html string").write.parquet(f"{top}/pages.parquet")
    return top


def asked(spark, folder, name):
    (query,) = [q for k, q in registry.queries().items() if k.startswith(name + "_")]
    return query(spark, folder)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_packing_digest(spark, folder, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for k, t in rows}
    got, seen = asked(spark, folder, "op2").collect(), {k: [] for k in ids}
    places = {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.asarray(part, "<u4").tobytes())
        seen[r.doc_id] += range(r.start, r.start + r.length)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(seen[k]) == list(range(len(v))) for k, v in ids.items())
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 2048


def test_repeats_digest(spark, folder, rows):
    data = {k: (t or "").encode() for k, t in rows}
    seen = Counter(d[s : s + 200] for d in data.values() for s in range(len(d) - 199))
    got = {r.doc_id: r for r in asked(spark, folder, "op5").collect()}
    removed = 0
    for k, d in data.items():
        cover = bytearray(len(d))
        for s in range(len(d) - 199):
            if seen[d[s : s + 200]] > 1:
                cover[s : s + 200] = b"\1" * 200
        rest = bytes(x for x, c in zip(d, cover, strict=True) if not c)
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(d), len(d) - len(rest), len(re.findall(b"\1+", bytes(cover))), sha(rest))
        removed += len(d) - len(rest)
    assert removed > 2000 and len(got) == len(rows)


def test_bpe_digest(spark, folder, rows):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in asked(spark, folder, "op7").collect()}
    for k, t in rows:
        ids = known.encode_ordinary(t or "")
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))


def test_secrets_digest(spark, folder, rows):
    assign = regex.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", regex.ASCII)
    got = {r.doc_id: r for r in asked(spark, folder, "op9").collect()}
    found = 0
    for k, t in rows:
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[i]}:{s}:{e}" for s, i, e in sorted(spans))
        r = got[k]
        assert ((r.n_assign, r.n_access, r.n_hex), r.base_sha256) == (tuple(sum(i == j for _, i, _ in spans) for j in range(3)), sha(text.encode()))
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
        found += len(spans)
    assert found >= 4


def test_minhash_and_language_and_quality(spark, folder, rows):
    near = {r.doc_id: r for r in asked(spark, folder, "op10").collect()}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        n = len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w))
        assert near[k].n_shingles == n and near[k].kept == (near[k].component_id == k)
    assert (near[5].component_id, near[6].component_id, near[7].component_id) == (5, 5, 5)
    spoken = {r.doc_id: r for r in asked(spark, folder, "op4").collect()}
    assert all(spoken[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= spoken[k].score <= 1 for k in spoken)
    assert [spoken[k].lang_pred for k in range(4)] == ["und"] * 4 and spoken[9].lang_pred in ("xx", "yy")
    judged = {r.doc_id: r for r in asked(spark, folder, "op8").collect()}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert (judged[k].n_words, judged[k].word_chars) == (len(w), sum(map(len, w))) and not (judged[k].base_failed and judged[k].kept)


def test_vectors_pages_and_passages(spark, folder, rows):
    vectors = {r.vec_id: r for r in asked(spark, folder, "op1").collect()}
    assert len(vectors) == 41 and (vectors[90].n_links, vectors[90].component_id, vectors[90].kept) == (0, 90, True)
    pages = {r.page_id: r for r in asked(spark, folder, "op3").collect()}
    assert (pages[1].text, pages[1].n_chars, pages[2].text, pages[2].n_chars) == ("Text & more.", 12, "", 0)
    pairs = {(r.other_id, r.doc_id) for r in asked(spark, folder, "op6").collect()}
    assert {(5, 6), (5, 7)} <= pairs
