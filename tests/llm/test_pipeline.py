"""Each stage of the corpus pipeline, and all of them, on a small table with planted cases, against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from assetspark.llm import secrets

SECRET = "AKIA" + "Q7ZD" * 5


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    line, copy, other = words(60), words(120), words(130)
    out = [(k, words(rng.randint(60, 200))) for k in range(40)]
    out += [(100, copy), (101, copy + " tail"), (102, copy), (102, copy), (103, other), (100, other + " end")]
    out += [(k, words(70) + "\n" + line + "\n" + words(70)) for k in range(110, 116)]
    out += [(120, words(80) + " " + SECRET + " " + words(10)), (121, "few words"), (122, "same same same " * 40), (123, None), (124, ""), (None, words(90))]
    # clean rows and spoilt ones, told apart by their symbols
    out += [(1000 + k, words(80) + (" # $ %" * 30 if k % 2 else "")) for k in range(120)]
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sf"))
    made = [(i, t, "en", "web", None if t is None else len(t), "mine", "raw", 3) for i, t in rows]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, _kept string, _t string, k int")
    docs.repartition(3).write.parquet(f"{top}/documents.parquet")
    labels = [(1000 + k, 0 if k % 2 else 1, 0) for k in range(120)] + [(1000, 1, 0), (None, 1, 0), (5, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def base_failed(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    again = {i + d for i, g in enumerate(grams) if seen[g] > 1 for d in range(3)}
    return len(w) < 50 or 100 * len(again) > 50 * len(w)


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def stage(name, spark, docs, folder):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    assert name == "packing" or out.columns == docs.columns
    return out


def test_quality_rules(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = texts(stage("quality_rules", spark, docs, folder))
    assert got == Counter((i, t) for i, t in rows if not base_failed(t) and "# $ %" not in t)
    assert stage("quality_rules", spark, docs.limit(0), folder).count() == 0


def test_near_duplicates(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    copy = next(t for i, t in rows if i == 100)
    gone = Counter([(101, copy + " tail"), (102, copy), (102, copy), (103, next(t for i, t in rows if i == 103))])
    assert texts(stage("near_duplicates", spark, docs, folder)) == Counter(rows) - gone
    assert stage("near_duplicates", spark, docs.limit(0), folder).count() == 0


def plain(data, length=200):
    seen = Counter(d[s : s + length] for d in data for s in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = np.zeros(len(d), bool)
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                cover[s : s + length] = True
        out.append(bytes(x for x, c in zip(d, cover, strict=True) if not c).decode(errors="ignore"))
    return out


def test_repeated_strings(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = stage("repeated_strings", spark, docs, folder)
    want = Counter((i, None if t is None else new) for (i, t), new in zip(rows, plain([(t or "").encode() for _, t in rows]), strict=True))
    assert texts(got) == want and {(r["_kept"], r["_t"], r.k) for r in got.collect()} == {("mine", "raw", 3)}
    assert stage("repeated_strings", spark, docs.limit(0), folder).count() == 0


def test_secret_redaction(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = stage("secret_redaction", spark, docs, folder)
    assert texts(got) == Counter((i, t and t.replace(SECRET, "[SECRET]")) for i, t in rows)
    assert {(r["_kept"], r["_t"], r.k) for r in got.collect()} == {("mine", "raw", 3)}
    assert all(r.n_chars == len(r.text) for r in got.collect() if r.text is not None)
    assert stage("secret_redaction", spark, docs.limit(0), folder).count() == 0


def test_packing(spark, folder, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = stage("packing", spark, docs, folder).collect()
    assert sum(r.length for r in got) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert stage("packing", spark, docs.limit(0), folder).count() == 0


def test_all_stages(spark, folder, rows):
    got = corpus_pipeline.run(spark, folder)
    rest = [(i, t) for i, t in rows if not base_failed(t) and "# $ %" not in t]
    copy = next(t for i, t in rows if i == 100)
    out = Counter([(101, copy + " tail"), (102, copy), (103, next(t for i, t in rows if i == 103))])
    rest = [x for x in rest if x not in out]
    rest = [(i, new) for (i, _), new in zip(rest, plain([t.encode() for _, t in rest]), strict=True)]
    assert {r.doc_id for r in got.collect()} == {i for i, _ in rest}
    assert not re.search(secrets.ACCESS, " ".join(t.replace(SECRET, "") for _, t in rest))
