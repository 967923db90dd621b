"""Byte-level BPE encoding and decoding (operator 7).

A word's bytes are mapped to Latin-1 so that one Aho-Corasick pass gives the
longest vocabulary entry at each position.  The encoder then walks the word
with those longest matches, accepts a token only when it is compatible with the
token before it (no merge would have crossed or changed their border), tries
the next shorter entry otherwise and steps back when none is left.  Each
position is tried once for each token start, so the work is linear in the word.
Compatibility of two adjacent tokens is memoised.  Most words need no step back:
their longest matches, each from where the one before ends, all fit together,
and no other tokens of a word do.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Encoded words, and pairs of tokens, kept by each Python worker: at so many, those not used since the last time go.
WORD_CACHE, PAIR_CACHE = 200_000, 200_000


@lru_cache(maxsize=2)
def vocabulary(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank: all that decoding needs."""
    ids = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ids[int(rank)] = base64.b64decode(token)
    return [ids.get(k, b"") for k in range(max(ids) + 1)]


def decode(tokens: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))


class Bpe:
    """The encoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        self.pattern = regex.compile(pattern)
        self.tokens = vocabulary(path)
        self.ids = {token: rank for rank, token in enumerate(self.tokens) if token}
        self.trie = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.trie.add_word(token.decode("latin-1"), rank)
        self.trie.make_automaton()
        self.lengths = [len(t) for t in self.tokens]
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}  # ids as 32-bit integers
        self.aged: dict[str, bytes] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(len(self.tokens))]
        self.shorter = [self._prefix(t) for t in self.tokens]
        for rank, token in enumerate(self.tokens):
            self._split(rank, token)

    def _prefix(self, token: bytes) -> int:
        """The longest entry that is a proper prefix of ``token``, or -1."""
        for end in range(len(token) - 1, 0, -1):
            if (rank := self.ids.get(token[:end])) is not None:
                return rank
        return -1

    def _split(self, rank: int, token: bytes) -> None:
        """Finds the merge that makes ``token``; lower ranks are known by then."""
        left = self.shorter[rank] if len(token) > 1 else -1
        while left >= 0:
            right = self.ids.get(token[len(self.tokens[left]) :], rank)
            if left < rank and right < rank and self._compatible(left, right):
                self.parts[rank] = (left, right)
                self.merged[left, right] = rank
                return
            left = self.shorter[left]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` as neighbours.

        Undoes the later of the two merges step by step; a known merge of the
        facing parts that comes before that step would have crossed the border.
        """
        limit = len(self.tokens)
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, self.parts[left][1]
                if left == limit:
                    limit, right = right + 1, self.parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.parts[right][0]
                if right + 1 == limit:
                    limit, left = left, self.parts[left][1]
                    if left == limit:
                        return True

    def _fit(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= PAIR_CACHE:
                self.fits.clear()
            known = self.fits[pair] = self._compatible(left, right)
        return known

    def _word(self, data: bytes) -> list[int]:
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        size, lengths, fit = len(data), self.lengths, self._fit
        text = data.decode("latin-1")
        out = [rank for _, rank in self.trie.iter_long(text)]
        if sum(map(lengths.__getitem__, out)) == size and all(map(fit, out, out[1:])):
            return out
        longest = [-1] * size
        for end, rank in self.trie.iter(text):
            longest[end + 1 - lengths[rank]] = rank
        at, out = 0, []
        open_ = bytearray(b"\x01") * (size + 1)
        token = longest[0]
        while at < size:
            if token < 0:  # nothing fits from here: give back the last token
                open_[at] = 0
                last = out.pop()
                at -= lengths[last]
                token = self.shorter[last]
                continue
            end = at + lengths[token]
            if open_[end] and (not out or fit(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < size else -1
            else:
                token = self.shorter[token]
        return out

    #: A blank with white space on both sides, or before the end: matches may then cross it.
    _tangled = re.compile(r"\s (?:\s|\Z)")

    def encode(self, text: str) -> np.ndarray:
        """The ids of ``text``, each match of the pattern encoded separately.

        Matches never cross a blank that starts a word, so the text is cut
        there first and cut pieces are looked up whole; texts where blanks
        meet other white space are matched as one piece.
        """
        if self._tangled.search(text):
            pieces = [m[0] for m in self.pattern.finditer(text)]
        else:
            first, *rest = text.split(" ")
            pieces = ([first] if first else []) + [" " + x for x in rest]
        get, known = self.words.get, self._known
        return np.frombuffer(b"".join([get(x) or known(x) for x in pieces]), np.int32)

    def _known(self, piece: str) -> bytes:
        out = self.aged.get(piece)
        if out is None:
            ids = [i for m in self.pattern.findall(piece) for i in self._word(m.encode())]
            out = array("i", ids).tobytes()
        if len(piece) <= 256:
            if len(self.words) >= WORD_CACHE:
                self.aged, self.words = self.words, {}
            self.words[piece] = out
        return out


@lru_cache(maxsize=2)
def model(path: str, pattern: str) -> Bpe:
    """One model for each Python worker and rank file."""
    return Bpe(path, pattern)


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """(id_col, ids array<int>) for each row; a null text counts as empty.

    With ``decoded`` the ids are decoded again in the same pass, which spares a
    second Python worker for each task.  Rows pass through one Arrow map without
    a shuffle.  Other columns of ``docs`` are not read, so their names cannot
    clash.  Repeated rows give repeated results and an empty table an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(x or "") for x in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))]
                if decoded:
                    columns.append(pa.array([decode(bpe.tokens, x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + (", decoded binary" if decoded else ""))


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids, decoded binary): the bytes of each row's ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path)
        for batch in batches:
            data = [b"" if x is None else b"".join(map(tokens.__getitem__, x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=[id_col, "ids", "decoded"]
            )

    rows = encoded.select(F.col(id_col), F.col(ids_col).alias("ids"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: ids of every whole document and their decoded bytes, as digests."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return encode_documents(table(spark, sf_dir, "documents"), path, pattern, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
