"""A Python worker that Spark uses again holds the caches of one operator at a time."""

import pyarrow as pa
import public_tokenizers

from assetspark.llm import minhash, packing


def test_what_others_kept_goes_when_a_task_begins():
    packing.tokenizer(public_tokenizers.path("word_bpe_49k.json")).encode("some words", b"")
    rows = pa.RecordBatch.from_pydict({"doc_id": [1], "text_hash": [2], "text": ["a b c d e f"]})
    assert packing.tokenizer.cache_info().currsize
    first = next(minhash._profile(iter([rows])))
    assert not packing.tokenizer.cache_info().currsize and len(minhash._words) == 6
    # a next task of the same operator finds its words again
    assert next(minhash._profile(iter([rows]))).equals(first) and len(minhash._words) == 6
