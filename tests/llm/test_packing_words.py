"""Words of the packing operator that are looked up for many texts together."""

import random

import numpy as np
import public_tokenizers

from assetspark.llm import packing


def test_unknown_words_of_many_texts_go_to_the_tokenizer_together(monkeypatch):
    words, end = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json")), np.asarray([1], "<u4").tobytes()
    rng, calls, library = random.Random(3), [], words.tokenizer

    class Counted:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, some, **named):
            calls.append(len(some))
            return library.encode_batch_fast(some, **named)

    words.tokenizer = Counted()
    texts = [" ".join(rng.choice(["The", "cat.", "naïve,", "x\x1cy", "e\u0301t", f"w{rng.randrange(900)}!"]) for _ in range(rng.randrange(30))) for _ in range(400)]
    want = [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert [x.tolist() for x in words.encode_all(texts, end)] == want
    assert len(calls) == 1  # one for each text with an unknown word before
    # words that go from the cache while texts wait are looked up again
    monkeypatch.setattr(packing, "WORD_CACHE", 50)
    monkeypatch.setattr(packing, "NEW_WORDS", 20)
    assert [x.tolist() for x in words.encode_all(texts, end)] == want
    monkeypatch.setattr(packing, "HELD_WORDS", 1)
    assert [x.tolist() for x in words.encode_all(texts, end)] == want
