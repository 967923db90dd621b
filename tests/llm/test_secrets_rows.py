"""Secret scans: masking whole tables, clashing columns, and texts with very many matches."""

import random
import re
import string

from assetspark.llm import secrets


def test_redact_changes_nothing_else(spark):
    key = "AKIA" + "B2C3" * 5
    rows = [
        (1, f"id {key} end", 5, "raw", "x", 0),
        (1, f"id {key} end", 5, "raw", "x", 0),
        (2, "plain text", 10, f"raw {key}", "y", 1),
        (None, None, None, None, None, 2),
        (3, "", 0, "", "", 3),
        (4, f"password={key} " + "0f" * 20 + "é🙂" + "0e" * 16, 1, "", "", 4),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _t string, _spans string, _random int").repartition(2)
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    got = sorted((tuple(r) for r in out.collect()), key=str)
    hidden = "[SECRET] [SECRET]é🙂[SECRET]"
    want = [(1, "id [SECRET] end", 15, "raw", "x", 0)] * 2 + [rows[2], rows[3], rows[4], (4, hidden, len(hidden), "", "", 4)]
    assert got == sorted(want, key=str)
    assert secrets.redact(docs.limit(0)).count() == 0


def test_very_many_matches_in_one_text(spark):
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choices(string.ascii_letters + "é🙂", k=rng.randint(1, 9))) for _ in range(n))
    text = " ".join(f"{words(rng.randint(0, 12))} token={''.join(rng.choices('0123456789abcdef', k=32))}" for _ in range(3000)) + " " + words(3000)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = secrets.find_secrets(docs).select(secrets.joined(("assign", "hex")).alias("x")).first().x
    assign, hex_ = re.compile(secrets.ASSIGN, re.ASCII), re.compile(secrets.HEX)
    want = sorted([(m.start(), "assign", m.end()) for m in assign.finditer(text)] + [(m.start(), "hex", m.end()) for m in hex_.finditer(text)])
    assert found == ",".join(f"{k}:{s}:{e}" for s, k, e in want)
    assert secrets.redact(docs).first().text == assign.sub("[SECRET]", text)


def test_thresholds_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(5)
    rows = [(k, "".join(rng.choices(string.ascii_letters + string.digits, k=rng.randint(20, 60))) + " " + "".join(rng.choices("etaoinshrdlu", k=rng.randint(20, 40)))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = [secrets.calibrate(secrets.with_tokens(secrets.with_base(docs.repartition(n).withColumnRenamed("text", "_t")))) for n in (1, 7)]
    assert made[0] == made[1] and made[0][1]


def test_corpora_without_secrets_or_words(spark):
    rng = random.Random(6)
    names = ["user_account_settings_page", "src/main/java/org/example", "Rechtsschutzversicherungsgesellschaft", "internationalization", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "2024-01-01-2024-12-31-2025"]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(names, k=5))) for k in range(100)], "doc_id long, text string")
    assert {r.x for r in secrets.find_secrets(docs).select(secrets.joined(("random",)).alias("x")).collect()} == {""}
