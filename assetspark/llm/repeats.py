"""Suffix-array removal of repeated byte strings (operator 5).

Every string of ``length`` bytes holds an anchor: its rightmost byte 64-gram of
the smallest hash.  Equal strings choose the same one, so a string can repeat
only where anchors of the same hash meet, and the bytes around an anchor that
belong to strings that chose it, its context, are bounded.

1. One pass over the texts gives each anchor's hash and its context's hash.
2. Anchors whose hash occurs once are done.  Where all contexts of a hash are
   equal, all their strings repeat.
3. Of different contexts under one hash, the parts where they share the bytes
   that nearby strings have in common are sorted with ``suffix_array`` some
   fifty kilobytes at a time, which caches hold, one copy of each; neighbours that agree on
   ``length`` bytes repeat.  Contexts alone with those bytes are not sorted, and
   neither are parts that are all equal, as those repeat throughout.  Hashes with very many anchors are dealt again by
   the bytes that strings of nearby starts have in common; beyond ``HUGE``
   anchors each string is counted by its hash, with map-side sums, so no group
   of any size is collected.
4. Texts come in once to give anchors, once to give contexts, and once to lose
   what repeats.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import only, release, saved, scratched, table
from .suffixes import suffix_array

LENGTH = 200
#: Bytes of an anchor's gram, of a suffix array's text at most (beyond one group), and starts dealt together in large groups.
GRAM, TEXT, BAND = 64, 50_000, 16
#: Anchors of one hash from which a group is dealt again by its strings' common bytes, and from which each of its strings is counted alone.
LARGE, HUGE = 2_000, 200_000
#: Starts looked at together before sorting.
FINE = 4
#: Spans held before they leave a task.
KNOWN = 50_000
#: Bytes hashed and rows changed at a time; only bound memory.
SEGMENT, AT_ONCE = 1 << 20, 128

_rng = np.random.default_rng(23)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _grams(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings, by doubling."""
    h, width = _BYTE[data], 1
    while width < GRAM:
        h = h[: len(h) - width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every window of ``width`` values."""
    low, have = values, 1
    while have * 2 <= width:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    rest = width - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors: position, hash, and the first and last start of the strings that chose it.

    Each start of a string of ``length`` bytes belongs to exactly one anchor.
    """
    places, hashes, firsts = [], [], []
    width, starts = length - GRAM + 1, max(0, len(data) - length + 1)
    for at in range(0, starts, SEGMENT):
        h = _grams(np.frombuffer(data, np.uint8, min(len(data) - at, SEGMENT + length - 1), at))
        # the position in the low bits makes the rightmost of equal hashes the smallest
        ranked = (h & np.uint64(0xFFFFFFFFFF000000)) | (np.uint64(0xFFFFFF) - np.arange(len(h), dtype=np.uint64))
        spot = (np.uint64(0xFFFFFF) - (_minima(ranked, width) & np.uint64(0xFFFFFF))).astype(np.int64)
        first = np.flatnonzero(np.diff(spot, prepend=-1))
        places.append(spot[first] + at)
        hashes.append(h[spot[first]])
        firsts.append(first + at)
    if not places:
        none = np.empty(0, np.int64)
        return none, none.view(np.uint64), none, none
    p, h, first = map(np.concatenate, (places, hashes, firsts))
    fresh = np.flatnonzero(np.diff(p, prepend=-1))  # an anchor may go on in the next segment
    p, h, first = p[fresh], h[fresh], first[fresh]
    return p, h, first, np.append(first[1:], starts) - 1


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(context, first, last): runs of starts whose string occurs twice or more here."""
    if not contexts:
        return []
    sizes = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(sizes + 1) - 1  # where the separators are
    joined = b"\0".join(contexts) + b"\0"
    symbols = np.frombuffer(joined, np.uint8).astype(np.int32) + 1
    symbols[ends] = 0
    sa = suffix_array(symbols)
    room = np.repeat(ends, sizes + 1)[sa] - sa >= length
    both = np.flatnonzero(room[1:] & room[:-1])
    a, b = sa[both], sa[both + 1]
    if len(a):
        word = np.ascontiguousarray(np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,)))
        for k in (length - 8, *range((length - 8) // 8 * 8, -1, -8)):  # neighbours differ late, if at all
            same = word[a + k] == word[b + k]
            a, b = a[same], b[same]
    flag = np.zeros(len(joined) + 1, np.int8)
    flag[a] = flag[b] = 1
    # a run ends before its context does, as the last starts have no room
    step = np.diff(flag, prepend=0)
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1
    of = np.searchsorted(ends, first)
    begin = (ends - sizes)[of]
    return list(zip(of.tolist(), (first - begin).tolist(), (last - begin).tolist(), strict=True))


def _sharing(group: list[tuple], length: int) -> tuple[list[tuple], list[tuple]]:
    """What of a group's contexts may repeat: parts to sort as (h, c, offset, bytes), and spans known to.

    Strings whose starts, counted from the anchor, lie in one band of FINE all
    hold the bytes in the band's middle, so a context that is alone with those
    needs no sorting there.  The bands that stay are joined to parts.  One copy
    of equal parts is sorted, and none if the group has no other part.
    """
    reach = length - GRAM
    banded, seen = [], Counter()
    for *_, data, mid in group:
        some = []
        for s in range(-reach, 1, FINE):
            low, high = max(0, mid + s), min(len(data) - length, mid + s + FINE - 1)
            if low <= high:
                some.append((low, high, (s, data[mid + min(s + FINE - 1, 0) : mid + s + length])))
        seen.update(x for _, _, x in some)
        banded.append(some)
    parts: dict[tuple[int, bytes], list[tuple]] = {}
    for (_, h, c, off, data, mid), some in zip(group, banded, strict=True):
        runs: list[list[int]] = []
        for low, high, x in some:
            if seen[x] > 1:
                if runs and runs[-1][1] == low - 1:
                    runs[-1][1] = high
                else:
                    runs.append([low, high])
        for low, high in runs:
            parts.setdefault((low - mid, data[low : high + length]), []).append((h, c, off + low, off + high))
    known = [span for same in parts.values() if len(same) > 1 for span in same]
    sort = [(*same[0][:3], data) for (_, data), same in parts.items()] if len(parts) > 1 else []
    return sort, known


def _key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """A row's id and the hash of its text, so that rows that share an id stay apart."""
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))), F.xxhash64(_text(text_col))


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def _batches(columns: list[list], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


@scratched
def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, t, spans): what each row with repeats loses, as sets of byte spans that may overlap.

    ``k`` and ``t`` are a row's id and the hash of its text.  Texts shorter than
    ``length`` never lose any.  Rows with equal id and text are told apart when
    strings are counted and share one result.
    """
    k, t = _key(id_col, text_col)
    rows = docs.select(k.alias("k"), t.alias("t"), _text(text_col).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("repeats")
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                out: list[list] = [[], [], [], [], [], [], []]
                for k, t, text in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    data = text.encode()
                    found_ = [x.tolist() for x in anchors(data, length)]
                    for p, h, a, z in zip(*found_, strict=True):
                        c = xxhash.xxh3_64_intdigest(data[a : z + length], p - a)
                        h, c = h - (1 << 64) if h >> 63 else h, c - (1 << 64) if c >> 63 else c
                        for col, v in zip(out, (h, c, k, t, p, p - a, z - a + length), strict=True):
                            col.append(v)
                yield _batches(out, [pa.int64()] * 4 + [pa.int32()] * 3, ["h", "c", "k", "t", "p", "left", "size"])

    found = saved(rows.mapInArrow(find, "h bigint, c bigint, k bigint, t bigint, p int, left int, size int"))
    groups = saved(
        found.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1").select("h", "n", (F.col("lo") != F.col("hi")).alias("mixed"))
    )
    occurs = saved(found.join(groups, "h"))
    release(found)
    classes = saved(
        occurs.where("mixed").groupBy("h", "c")
        .agg(F.count("*").alias("copies"), F.min(F.struct("k", "t", "p", "left", "size", "n")).alias("at"))
        .select("h", "c", "copies", "at.*")
    )
    asked = classes.groupBy("k", "t").agg(F.collect_list(F.struct("h", "c", "p", "left", "size", "n")).alias("asked"))
    held = rows.join(saved(asked), ["k", "t"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("repeats")
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                out: list[list] = [[], [], [], [], [], []]
                for text, some in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = text.encode()
                    for x in some:
                        a, b = x["p"] - x["left"], x["p"] - x["left"] + x["size"]
                        bands = [(a, b, x["h"])]
                        if x["n"] > HUGE:
                            continue
                        if x["n"] > LARGE:  # strings that start in a band share the bytes in its middle
                            first, bands = x["p"] - (length - GRAM), []
                            for s in range(first, x["p"] + 1, BAND):
                                low, high = max(a, s), min(b - length, s + BAND - 1)
                                if low <= high:
                                    core = data[s + BAND - 1 : s + length] if s + BAND - 1 <= x["p"] else data[x["p"] : s + length]
                                    key = xxhash.xxh3_64_intdigest(core, (x["h"] + s - first) & (1 << 63) - 1)
                                    bands.append((low, high + length, key - (1 << 64) if key >> 63 else key))
                        for s, e, key in bands:
                            for col, v in zip(out, (key, x["h"], x["c"], s - a, data[s:e], x["p"] - s), strict=True):
                                col.append(v)
                        if sum(map(len, out[4][-64:])) > 1 << 24:
                            yield _batches(out, [pa.int64()] * 3 + [pa.int32(), pa.binary(), pa.int32()], ["g", "h", "c", "off", "data", "mid"])
                            out = [[], [], [], [], [], []]
                yield _batches(out, [pa.int64()] * 3 + [pa.int32(), pa.binary(), pa.int32()], ["g", "h", "c", "off", "data", "mid"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("repeats")
        keys: list[tuple[int, int, int]] = []
        texts: list[bytes] = []
        done: list[tuple[int, int, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            done.extend((*keys[i][:2], keys[i][2] + a, keys[i][2] + b) for i, a, b in repeated_starts(texts, length))
            cols = [[x[k] for x in done] for k in range(4)]
            for used in (keys, texts, done):
                used.clear()
            return _batches(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], ["h", "c", "lo", "hi"])

        group: list[tuple] = []

        def take() -> None:
            nonlocal size
            some, known = _sharing(group, length)
            done.extend(known)
            for h, c, off, data in some:
                keys.append((h, c, off))
                texts.append(data)
                size += len(data)
            group.clear()

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if group and group[-1][0] != row[0]:
                    take()
                    if size > TEXT or len(done) > KNOWN:
                        yield flush()
                        size = 0
                group.append(row)
        take()
        if keys or done:
            yield flush()

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("repeats")
        for batch in batches:
            for text, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode()
                for x in some:
                    a = x["p"] - x["left"]
                    if x["n"] > HUGE:
                        each = range(x["size"] - length + 1)
                        keys = [xxhash.xxh3_64_intdigest(data[a + i : a + i + length]) for i in each]
                        yield _batches(
                            [[v - (1 << 64) if v >> 63 else v for v in keys], [x["h"]] * len(keys), [x["c"]] * len(keys), list(each)],
                            [pa.int64()] * 3 + [pa.int32()], ["g", "h", "c", "off"],
                        )

    parts = held.select("text", "asked").mapInArrow(contexts, "g bigint, h bigint, c bigint, off int, data binary, mid int")
    flagged = saved(parts.repartition("g").sortWithinPartitions("g").mapInArrow(sort, "h bigint, c bigint, lo int, hi int"))
    if not groups.where((F.col("n") > HUGE) & F.col("mixed")).isEmpty():
        each = saved(held.select("text", "asked").mapInArrow(singles, "g bigint, h bigint, c bigint, off int"))
        twice = each.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
        flagged = flagged.union(each.join(twice, "g").select("h", "c", F.col("off").alias("lo"), F.col("off").alias("hi")))
    whole = classes.where("copies > 1").select("h", "c", F.lit(0).alias("lo"), (F.col("size") - length).alias("hi"))
    marked = saved(flagged.union(whole))
    begin = F.col("p") - F.col("left")
    spans = (
        occurs.where("NOT mixed").select("k", "t", begin.alias("s"), (begin + F.col("size")).alias("e"))
        .union(occurs.where("mixed").join(marked, ["h", "c"]).select("k", "t", (begin + F.col("lo")).alias("s"), (begin + F.col("hi") + length).alias("e")))
    )
    return saved(spans.groupBy("k", "t").agg(F.collect_set(F.struct("s", "e")).alias("spans")), keep=True)


def _without(batches: Iterator[pa.RecordBatch], then: Callable[[bytes], object]) -> Iterator[pa.RecordBatch]:
    """(row, text, spans) to (row, text, n_removed, n_spans): ``then`` of the bytes that stay, for the rows with spans."""
    for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
        some = batch.column(2).is_valid()
        part = batch.filter(some)
        cols: list[list] = [[], [], []]
        for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
            data, at, n, out = text.encode() if isinstance(text, str) else text, -1, 0, []
            last = 0
            for s, e in sorted((x["s"], x["e"]) for x in spans):
                if s > at:
                    n += 1
                    out.append(data[last:s])
                at = last = max(at, e)
            out.append(data[last:])
            rest = b"".join(out)
            for col, v in zip(cols, (then(rest), len(data) - len(rest), n), strict=True):
                col.append(v)
        none = pa.array([0] * batch.num_rows, pa.int64())
        put = lambda old, new: pc.replace_with_mask(old, some, pa.array(new, old.type))
        yield pa.RecordBatch.from_arrays([batch.column(0), put(batch.column(1), cols[0]), put(none, cols[1]), put(none, cols[2])], names=["row", "text", "n_removed", "n_spans"])


def _reduced(docs: DataFrame, spans: DataFrame, how: str, row: Column, text: Column, then: Callable[[bytes], object], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, n_removed, n_spans) of the rows of ``docs`` that ``how`` joins with their spans; ``text`` of those without spans is left alone."""
    k, t = _key(id_col, text_col)
    both = docs.select(row.alias("row"), k.alias("k"), t.alias("t"), text.alias("text")).join(spans, ["k", "t"], how)
    given = both.select("row", "text", "spans")
    out = StructType([given.schema["row"], given.schema["text"], *(StructField(c, LongType()) for c in ("n_removed", "n_spans"))])
    return given.mapInArrow(lambda batches: _without(batches, then), out)


def repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, n_removed, n_spans, kept) of the rows that lose bytes: id, counts, and the bytes that stay."""
    spans, text = repeated_spans(docs, length, id_col, text_col), F.col(f"`{text_col}`").cast("string").cast("binary")
    return _reduced(docs, spans, "inner", F.col(f"`{id_col}`"), text, bytes, id_col, text_col).select(F.col("row").alias("k"), "n_removed", "n_spans", F.col("text").alias("kept"))


def _characters(rest: bytes) -> str:
    return rest.decode(errors="ignore")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without their repeated bytes; characters cut in half go too.

    ``n_chars`` is renewed for the rows that lose bytes.  All columns are
    returned, whatever their names; null texts stay null, rows that are equal
    all lose the same, an empty table stays empty.
    """
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`").alias(str(k)) for k, c in enumerate(others)])
    done = _reduced(docs, repeated_spans(docs, length), "left", row, F.col("text").cast("string"), _characters)
    new = {c: F.col("row").getField(str(k)) for k, c in enumerate(others)} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(new["n_chars"])
    return done.select(*[new[c].alias(c) for c in docs.columns])


def _digest(rest: bytes) -> str:
    return sha256(rest).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: what every document loses."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    whole = F.struct("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    done = _reduced(docs, repeated_spans(docs), "left", whole, F.col("text"), _digest)
    return done.select("row.doc_id", "row.n_bytes", "n_removed", "n_spans", F.when(F.col("n_removed") > 0, F.col("text")).otherwise(F.col("row.sha")).alias("kept_sha256"))
