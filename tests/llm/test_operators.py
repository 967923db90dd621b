"""The operators on small tables with planted cases, against plain versions."""

import base64
import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from assetspark.llm import bpe, embeddings, html, language, minhash, packing, passages, quality, repeats, secrets

WORDS = ["".join(random.Random(k).choices(string.ascii_lowercase, k=2 + k % 7)) for k in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = prose(rng, 120).split()
    out = [None, "", "   \n\t", "one two", "one two", "x" * 3000, "ab" * 900, "\x1c a  b \n c", prose(rng, 4000)]
    out += [prose(rng, rng.randint(1, 300)) for _ in range(40)]
    for _ in range(120):  # near copies on both sides of the threshold
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        out.append(" ".join(words))
    out += [out[20], out[20], "PREFIX " + out[21] + " é日本 " + out[22]]
    out += ["password=hunter22 and AKIA" + "A1B2" * 5 + " " + "0f" * 16, 'token: "ab" secret: token : abcdefgh', "🙂 Api-key api_key='abc.def-1'"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en", "clash", "clash", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, component_id string, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_bpe_equals_the_library(docs, empty, texts):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.decode_documents(bpe.encode_documents(docs, path, P.PATTERN), path))
    once = by_id(bpe.encode_documents(docs, path, P.PATTERN, decoded=True))
    for k, t in enumerate(texts):
        assert once[k] == got[k]
        assert list(got[k].ids) == known.encode_ordinary(t or "")
        assert bytes(got[k].decoded) == (t or "").encode()
    assert bpe.encode_documents(empty, path, P.PATTERN).count() == 0


def test_packing_keeps_every_token_and_pads_nothing(docs, empty, texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(docs, path).collect():
        pieces[r.doc_id].append((r.start, r.length, bytes(r.ids), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for k, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert b"".join(p[2] for p in sorted(pieces[k])) == np.asarray(ids, "<u4").tobytes()
        assert {p[3] for p in pieces[k]} == {len(ids)}
    for some in sequences.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at == packing.SEQUENCE or at & (at - 1) == 0
    assert packing.pack_documents(empty, path).count() == 0


def test_minhash_equals_brute_force(docs, empty, texts):
    sets = {}
    for k, t in enumerate(texts):
        w = minhash.words_of(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and sets[b]:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = by_id(minhash.near_duplicates(docs))
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(sets[k]), find(k), find(k) == k) for k in sets}
    assert minhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("large", [2000, 2])
def test_repeats_equal_brute_force(docs, empty, texts, large, monkeypatch):
    monkeypatch.setattr(repeats, "LARGE", large)
    data = {k: (t or "").encode() for k, t in enumerate(texts)}
    seen = Counter(d[s : s + 200] for d in data.values() for s in range(len(d) - 199))
    got = {r.k: r for r in repeats.repeats(docs).collect()}
    for k, d in data.items():
        cover = bytearray(len(d))
        for s in range(len(d) - 199):
            if seen[d[s : s + 200]] > 1:
                cover[s : s + 200] = b"\1" * 200
        rest = bytes(x for x, c in zip(d, cover, strict=True) if not c)
        assert bytes(got[k].kept if k in got else d) == rest
        if k in got:
            assert got[k].n_removed == len(d) - len(rest) and got[k].n_spans == len(re.findall(b"\1+", bytes(cover)))
    assert repeats.repeats(empty).count() == 0


def test_quality_counts_and_list(spark, docs, empty, texts):
    got = by_id(quality.judge(docs, [(quality.Condition("symbol_share", True, 0.2),)]))
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {i + d for i, g in enumerate(grams) if Counter(grams)[g] > 1 for d in range(3)} if len(w) < 500 else None
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert twice is None or r.n_repeat_words == len(twice)
        assert not (r.base_failed and r.kept)
    assert quality.judge(empty, []).count() == 0


def test_decision_list_finds_the_rule():
    rng = np.random.default_rng(1)
    x = rng.random((600, len(quality.FEATURES)))
    bad = (x[:, 2] > 0.7) & (x[:, 5] <= 0.5)
    rules = quality.learn(x, bad, rng.random(600) < 0.67)
    hit = np.zeros(600, bool)
    for r in rules:
        hit |= quality._covers(r, x)
    assert (hit == bad).mean() > 0.97
    assert quality.learn(x, np.zeros(600, bool), rng.random(600) < 0.67) == []
    assert quality.learn(np.zeros((0, len(quality.FEATURES))), np.zeros(0, bool), np.zeros(0, bool)) == []


def test_secrets_base_spans(docs, empty, texts):
    found = secrets.find_secrets(docs)
    got = {r.doc_id: r.spans for r in found.select("doc_id", secrets.joined(secrets.KINDS[:3]).alias("spans")).collect()}
    assign = re.compile(secrets.ASSIGN, re.ASCII)
    for k, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert got[k] == ",".join(f"{secrets.KINDS[i]}:{s}:{e}" for s, i, e in sorted(spans))
    assert secrets.find_secrets(empty).count() == 0


def test_secrets_adds_random_tokens_only(spark):
    rng = random.Random(4)
    rows = [(k, "some words here " + "".join(rng.choices(string.ascii_letters + string.digits, k=64)) + " Donaudampfschifffahrtsgesellschaft some_long_identifier_name2") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.spans for r in secrets.find_secrets(docs).select(secrets.joined(("random",)).alias("spans")).collect()]
    assert sum(s == "random:16:80" for s in got) >= 50 and set(got) <= {"", "random:16:80"}
    assert sum("[SECRET]" in r.text for r in secrets.redact(docs).collect()) >= 50


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, base = [], rng.standard_normal((12, 16))
    for k in range(400):
        v = base[k % 12] + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.3])
        rows.append((k, [float(x) for x in v], int(rng.integers(3)) if k % 17 else None))
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [1.0] * 8, 1), (404, [], 1), (405, rows[0][1], rows[1][2]), (405, rows[0][1], rows[1][2])]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = by_id(embeddings.near_vectors(made), "vec_id")
    data = {r.vec_id: (np.array(r.embedding, float), r.label) for r in made.collect() if r.label is not None and r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)}
    near = {k: set() for k in got}
    for a, (x, i) in data.items():
        for b, (y, j) in data.items():
            if a < b and i == j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                near[a].add(b), near[b].add(a)
    assert sum(map(len, near.values())) > 500
    for k, r in got.items():
        part, todo = {k}, [k]
        while todo:
            for b in near[todo.pop()] - part:
                part.add(b), todo.append(b)
        assert (r.n_links, r.component_id, r.kept) == (len(near[k]), min(part), min(part) == k)
    assert embeddings.near_vectors(made.limit(0)).count() == 0


def test_language_by_compression(spark):
    rng = random.Random(2)
    tongues = {"aa": "la mi no re su ta vo".split(), "bb": "krz twsk plnt brgh stck".split(), "cc": "日 本 語 文 字".split()}
    rows = [(k, " ".join(rng.choices(tongues[t], k=40)), t) for k, t in enumerate(rng.choices(list(tongues), k=300))]
    rows += [(1000, None, "aa"), (1001, "12 !!", "bb"), (1002, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(language.identify(docs, language.train(docs)))
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    assert sum(got[k].lang_pred == t for k, _, t in rows[:300]) >= 297
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert language.train(docs.limit(0)) == {} and language.identify(docs.limit(0), {}).count() == 0


def test_html_main_text(spark):
    page = (
        '<html><head><title>no</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>'
        "<article><h1>A title &amp; more</h1><p><b>First  paragraph of the article, with some words.<br><p>Second one &eacute;.</p><div class='comments'><p>Nice post!</p></div></article>"
        '<aside><p>Related things.</p></aside><footer>&copy; somebody</footer>'
    )
    made = spark.createDataFrame([(1, "u", page), (2, "v", None), (3, None, ""), (4, "w", "<<p <b>"), (4, "w", "<<p <b>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.extract_pages(made).collect()}
    assert got[1].text == "A title & more\nFirst paragraph of the article, with some words.\nSecond one é."
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == ""
    assert html.extract_pages(made.limit(0)).count() == 0


def test_html_trees_on_unseen_pages():
    model = html.trained()
    right = total = 0
    for page in html.pages_for_training(60, seed=77):
        root = html.parse(page.replace(" data-keep", ' role="keepme"'))
        nodes = html.measure(root)
        want = np.array([n is root or "keepme" in n.words for n in nodes])
        for n in nodes:
            n.words = tuple(w for w in n.words if w != "keepme")
        right += (html.decode(nodes, model.score(html.features(nodes))) == want).sum()
        total += len(nodes)
    assert right / total > 0.97


def test_passages_find_shared_and_fuzzy_ones(spark):
    rng = random.Random(9)
    passage = prose(rng, 80).split()
    fuzzy = list(passage)
    for k in (20, 45, 66):
        fuzzy[k] = "changed"
    rows = [(k, prose(rng, 150)) for k in range(30)]
    rows += [(100, prose(rng, 50) + " " + " ".join(passage) + " " + prose(rng, 30)), (101, prose(rng, 20) + " " + " ".join(passage).upper()), (102, " ".join(fuzzy) + " " + prose(rng, 60))]
    rows += [(103, None), (104, ""), (105, "a b c"), (106, "w " * 300), (106, "w " * 300)]
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.other_id, r.doc_id) for r in got} == {(100, 101), (100, 102)}
    for r in got:
        assert r.end - r.start >= 75 and r.identity > 0.9
    assert passages.passages(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0
    digest = hashlib.sha256(repr(sorted(got)).encode()).hexdigest()
    assert digest == hashlib.sha256(repr(sorted(passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())).encode()).hexdigest()


def test_quality_counts_of_symbols_and_long_texts(spark, docs, texts):
    rng = random.Random(8)
    long_ = " ".join(rng.choice("ab") + rng.choice("cd#$") for _ in range(3000)) + "\n\nx y\nx y\n x y"
    more = [*texts, long_, "# * $ % & | < > #a", "a b c a b c", None]
    made = spark.createDataFrame([(k, t) for k, t in enumerate(more)], "doc_id long, text string")
    got = by_id(quality.judge(made, []))
    for k, t in enumerate(more):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = Counter(grams)
        again = {i + d for i, g in enumerate(grams) if seen[g] > 1 for d in range(3)}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        r = got[k]
        assert (r.n_symbols, r.n_repeat_words, r.base_failed, r.kept) == (len(re.findall(r"[#*$%&|<>]", t)), len(again), failed, not failed)
