"""Training texts are read whole."""

import random

from assetspark.llm import language


def test_language_behind_a_common_header(spark):
    rng = random.Random(6)
    tongues = {"aa": ["".join(rng.choices("aeilmnorst", k=5)) for _ in range(80)], "bb": ["".join(rng.choices("bdfghkpvwz", k=5)) for _ in range(80)]}
    header = " ".join("".join(rng.choices("abcdefghijkl", k=6)) for _ in range(600))
    rows = [(k, header + " " + " ".join(rng.choices(tongues[t], k=60)), t) for k, t in enumerate(rng.choices(list(tongues), k=400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language.train(docs)
    assert learned["aa"] != learned["bb"] and all(len(d) <= language.DICTIONARY for d in learned.values())
    plain = spark.createDataFrame([(k, " ".join(rng.choices(tongues[t], k=60)), t) for k, t in enumerate(["aa", "bb"] * 50)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(plain, learned).collect()}
    assert all(got[k].lang_pred == t and not got[k].rejected for k, t in enumerate(["aa", "bb"] * 50))


def test_language_behind_figures(spark):
    rows = [(k, "0123456789 " * 2000 + "la mi no re su ta vo", "aa") for k in range(20)]
    learned = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(learned["aa"].decode().split()) == set("la mi no re su ta vo".split())
