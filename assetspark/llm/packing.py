"""Cost-balanced sequence packing (operator 2).

Each input partition is packed where it lies, in blocks of a bounded number of
tokens, so nothing is shuffled and token ids never leave the executor before
they are packed.  Within a block, documents in descending order of estimated
cost (linear plus quadratic in their length, as attention has it) go to the
lowest-cost sequence that has room.  A document that no sequence has room for
is cut.  Sequence capacities of a block add up to exactly its tokens: full
sequences, and powers of two for what is left, which need no padding.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keeps, only, table

SEQUENCE = 2048
#: Tokens packed at a time by one task; bounds its memory, and decides which documents share sequences.
BLOCK_TOKENS = 4_000_000
#: Cost of a document of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / SEQUENCE
#: Words kept by each Python worker: at so many, those not used since the last time go.
WORD_CACHE = 300_000
#: Texts are looked up together until so many words are unknown, or there are so many words.
NEW_WORDS, HELD_WORDS = 4096, 500_000
#: A mark between a letter and white space is split off by the pre-tokenizer in any case.
MARK = re.compile(r"(?<=[a-z])[.,;:!?](?=\s|\Z)")


class WordTokenizer:
    """Ids of a tokenizer that drops white space, looked up word by word.

    Its pre-tokenizer never joins text across white space, so a word between
    white space has the same ids in any context.  It lower-cases, and splits
    marks off words, so both are done here first: fewer words differ then.
    Texts with the control
    characters that Python but not the tokenizer's pattern takes as white space,
    or with special tokens, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join(["[\x1c-\x1f]", *special]))
        self.words: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}

    def _words(self, text: str) -> list[str] | None:
        """The words to look up; None where the tokenizer must see the text whole."""
        if self.whole.search(text):
            return None
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return MARK.sub(r" \g<0>", text.encode().lower().decode()).split()

    def _learn(self, missing: set[str]) -> None:
        known, aged, new = self.words, self.aged, []
        for w in missing:
            if (ids := aged.get(w)) is None:
                new.append(w)
            else:
                known[w] = ids
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[w] = array("I", e.ids).tobytes()

    def encode_all(self, texts: list[str], end: bytes) -> Iterator[np.ndarray]:
        """The ids of each text as little-endian unsigned integers, with ``end`` after them.

        Texts are taken together until they have ``NEW_WORDS`` words that are not
        known, as a call of the tokenizer for few words costs three times as much a word.
        """
        waiting: list[tuple[str, list[str] | None]] = []
        missing: set[str] = set()
        held = 0
        for text in texts:
            parts = self._words(text)
            waiting.append((text, parts))
            if parts:
                held += len(parts)
                missing.update(set(parts).difference(self.words))
            if len(missing) >= NEW_WORDS or held >= HELD_WORDS:
                yield from self._encoded(waiting, missing, end)
                waiting, missing, held = [], set(), 0
        yield from self._encoded(waiting, missing, end)

    def _encoded(self, waiting: list[tuple[str, list[str] | None]], missing: set[str], end: bytes) -> Iterator[np.ndarray]:
        if len(self.words) + len(missing) > WORD_CACHE:
            self.aged, self.words = self.words, {}
            missing = {w for _, parts in waiting for w in parts or ()}
        self._learn(missing)
        for text, parts in waiting:
            if parts is None:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                yield np.frombuffer(np.asarray(ids, "<u4").tobytes() + end, "<u4")
            else:
                yield np.frombuffer(b"".join(map(self.words.__getitem__, parts)) + end, "<u4")

    def encode(self, text: str, end: bytes) -> np.ndarray:
        """As ``encode_all``, for one text."""
        return next(self.encode_all([text], end))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordTokenizer(path)


keeps("packing", tokenizer.cache_clear)


def cost(tokens: int) -> float:
    return LINEAR * tokens + QUADRATIC * tokens * tokens


def capacities(total: int, size: int = SEQUENCE) -> list[int]:
    """Full sequences, then powers of two that add up to what is left."""
    left = total % size
    return [size] * (total // size) + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def pack(lengths: list[int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of one block.

    Every token lies in exactly one piece and every sequence is full.  Ties go
    to the earlier document and the earlier sequence.
    """
    room = capacities(sum(lengths), size)
    used = [0] * len(room)
    spent = [0.0] * len(room)
    cheap = [(0.0, s) for s in range(len(room))]
    heapq.heapify(cheap)
    tight: list[list[int]] = [[] for _ in range(size + 1)]  # by room, sequences too full for the present piece
    work = [(-min(n, size), d, 0) for d, n in enumerate(lengths) if n]
    heapq.heapify(work)
    out, low = [], size + 1  # no sequence with room of ``low`` or more is in ``tight``
    while work:
        minus, doc, start = heapq.heappop(work)
        want = -minus
        while low > want:  # pieces got shorter: those sequences have room again
            low -= 1
            for s in tight[low]:
                heapq.heappush(cheap, (spent[s], s))
            tight[low].clear()
        while cheap and room[cheap[0][1]] < want:
            s = heapq.heappop(cheap)[1]
            tight[room[s]].append(s)
        if cheap:
            s = heapq.heappop(cheap)[1]
            length = want
        else:  # room for no whole piece: cut it to the largest room there is
            length = next(r for r in range(min(want, low) - 1, 0, -1) if tight[r])
            s = min(tight[length], key=lambda x: (spent[x], x))
            tight[length].remove(s)
        out.append((doc, start, length, s, used[s]))
        used[s] += length
        room[s] -= length
        spent[s] += cost(length)
        if room[s] >= low:
            heapq.heappush(cheap, (spent[s], s))
        elif room[s]:
            tight[room[s]].append(s)
        if left := min(lengths[doc] - start - length, size):
            heapq.heappush(work, (-left, doc, start + length))
    return out


def pack_documents(
    docs: DataFrame,
    path: str,
    end_id: int = 1,
    size: int = SEQUENCE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id_col, start, length, ids, doc_tokens, sequence_id, offset) of each piece.

    A null text counts as empty and yields its end token alone.  Sequence ids
    are those of the partition (upper bits) and of the sequence in it, so a task
    that is run again gives the same ones.  Repeated rows are packed each by
    itself; other columns are not read; an empty table yields no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        only("packing")
        words = tokenizer(path)
        end = np.asarray([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 36
        keys: list = []
        ids: list[np.ndarray] = []
        tokens = 0

        def flush():
            nonlocal first, tokens
            pieces = pack([len(x) for x in ids], size)
            for at in range(0, len(pieces), 4096):
                some = pieces[at : at + 4096]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[p[0]] for p in some], kind),
                        pa.array([p[1] for p in some], pa.int64()),
                        pa.array([p[2] for p in some], pa.int64()),
                        pa.array([ids[p[0]][p[1] : p[1] + p[2]].tobytes() for p in some], pa.binary()),
                        pa.array([len(ids[p[0]]) for p in some], pa.int64()),
                        pa.array([first + p[3] for p in some], pa.int64()),
                        pa.array([p[4] for p in some], pa.int64()),
                    ],
                    names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            first += 1 + max((p[3] for p in pieces), default=-1)
            keys.clear()
            ids.clear()
            tokens = 0

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = words.encode_all([x or "" for x in part.column(1).to_pylist()], end)
                for key, some in zip(part.column(0).to_pylist(), made, strict=True):
                    keys.append(key)
                    ids.append(some)
                    tokens += len(ids[-1])
                    if tokens >= BLOCK_TOKENS:
                        yield from flush()
        if keys:
            yield from flush()

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    of = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"`{id_col}` {of}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint",
    )


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return digest(pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
