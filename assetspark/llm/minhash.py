"""MinHash near-duplicate detection with sequential Bayesian verification (operator 10).

1. One Arrow map turns each text into the fingerprint of its shingle set and a
   MinHash signature.  Texts with the same set form a class; only one row a
   class goes on, so exact copies cost nothing later.
2. Classes that share a band of the signature are candidates.  Within a bucket
   their signatures are compared batch by batch; a pair is dropped once the
   posterior probability that its similarity reaches the threshold falls below
   ``MISS``.  Of the pairs that stay only a spanning forest leaves the task: its
   components are clusters that hold every possible link.
3. Within a cluster, pairs that the bounds keep are verified on the full shingle
   sets unless they are connected already, and again a forest of the links
   leaves the task.

Buckets and clusters of any size are compared in blocks, so no task gets more
than two blocks; see ``_forests`` for what a large one costs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keeps, only, release, saved, scratched, table
from .graph import components

#: Words of a shingle; intersection / union that links, as a fraction of whole numbers.
SHINGLE, LINK_NUM, LINK_DEN = 5, 85, 100
#: A pair at the threshold shares no band with probability (1 - 0.85**6)**30 < 1e-6.
BANDS, ROWS = 30, 6
#: Signature values compared at a time, and the posterior probability at which a pair is dropped.
BATCH, MISS = 36, 1e-7
WORD_CACHE = 200_000
#: Classes compared at a time: by signature in a bucket, by their full sets in a cluster.
BLOCK, SET_BLOCK = 1024, 256
#: Rows turned to Python objects at a time.
PIECE = 256

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_PLACE, _SCALE, _SHIFT = _odd(SHINGLE, 11), _odd(BANDS * ROWS, 12), _odd(BANDS * ROWS, 13)


class Words(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = made = xxhash.xxh3_64_intdigest(word)
        return made


_words = Words()
keeps("minhash", _words.clear)


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; only the six ASCII blanks separate words."""
    return text.encode().lower().split() if text else []


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of the text's set of shingles."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > WORD_CACHE:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), len(h))], np.uint64)
    n = len(h) - SHINGLE + 1
    out = h[:n] * _PLACE[0]
    for k in range(1, SHINGLE):
        out += h[k : k + n] * _PLACE[k]
    out ^= out >> np.uint64(29)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of the set under as many hash functions."""
    low = np.full(len(_SCALE), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        part = hashes[at : at + 1024]
        np.minimum(low, (part[None, :] * _SCALE[:, None] + _SHIFT[:, None]).min(axis=1), out=low)
    return low


@lru_cache(maxsize=4)
def least_matches(total: int, batch: int, num: int, den: int, miss: float) -> tuple[int, ...]:
    """For each batch end, the least number of agreeing values that keeps a pair.

    With a uniform prior the similarity after m agreements of n has a
    Beta(m + 1, n - m + 1) posterior; P(s >= t) is then the chance of at most m
    successes in n + 1 trials of probability t.
    """
    t, out = num / den, []
    for n in range(batch, total + 1, batch):
        term, tail, m = (1 - t) ** (n + 1), 0.0, 0
        while True:
            tail += term
            if tail >= miss:
                break
            m += 1
            term = math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def survives(a: np.ndarray, b: np.ndarray, batch: int = BATCH, miss: float = MISS) -> np.ndarray:
    """Which rows of two signature matrices no batch's posterior bound drops.

    Only the low byte of each value is kept; chance agreement of those can keep
    a pair but never drops one.
    """
    alive = np.arange(len(a))
    agree = np.zeros(len(a), int)
    for k, least in enumerate(least_matches(a.shape[1], batch, LINK_NUM, LINK_DEN, miss)):
        at = slice(k * batch, (k + 1) * batch)
        agree[alive] += (a[alive, at] == b[alive, at]).sum(axis=1)
        alive = alive[agree[alive] >= least]
    keep = np.zeros(len(a), bool)
    keep[alive] = True
    return keep


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold, in whole numbers."""
    if LINK_DEN * min(len(a), len(b)) < LINK_NUM * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LINK_DEN * both >= LINK_NUM * (len(a) + len(b) - both)


def _fingerprint(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, text) to (doc_id, text_hash, n_shingles, fp, sig, bands)."""
    only("minhash")
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            part = batch.slice(at, PIECE)
            rows: list[tuple] = []
            for text in part.column(2).to_pylist():
                s = shingles(text)
                if len(s):
                    low = signature(s)
                    keys = [
                        int.from_bytes(hashlib.blake2b(low[k * ROWS : (k + 1) * ROWS].tobytes(), digest_size=8, salt=bytes([k])).digest(), "little", signed=True)
                        for k in range(BANDS)
                    ]
                    rows.append((len(s), _fingerprint(s), (low & np.uint64(0xFF)).astype(np.uint8).tobytes(), keys))
                else:
                    rows.append((0, None, None, None))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(cols[0], pa.int64()),
                    pa.array(cols[1], pa.binary()),
                    pa.array(cols[2], pa.binary()),
                    pa.array(cols[3], pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "n_shingles", "fp", "sig", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, text) to (fp, set) where the text has that fingerprint."""
    only("minhash")
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            part = batch.slice(at, PIECE)
            found = [shingles(x) for x in part.column(1).to_pylist()]
            keep = [_fingerprint(s) == fp for fp, s in zip(part.column(0).to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).filter(pa.array(keep)), pa.array([s.tobytes() for s, k in zip(found, keep, strict=True) if k], pa.binary())],
                names=["fp", "words"],
            )


class _Forest:
    """Pairs of one group's classes that connect parts of it not connected before."""

    def __init__(self, rows: list[tuple]):
        """``rows``: (side, part, fp, sig[, words]); null sides are compared with each other, else side 1 with side 0."""
        self.fps = [r[2] for r in rows]
        self.side = None if rows[0][0] is None else np.array([r[0] for r in rows])
        self.part = np.arange(len(rows)) if self.side is None else np.unique([r[1].hex() for r in rows], return_inverse=True)[1]
        self.sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
        self.sets = [np.frombuffer(r[4], np.uint64) for r in rows] if len(rows[0]) > 4 else None

    def edges(self) -> Iterator[tuple[bytes, bytes]]:
        """Stars about the least member of each part that grew."""
        first, part, every = self.part.copy(), self.part.copy(), np.arange(len(self.fps))
        for k in every if self.side is None else every[self.side == 1]:
            others = every[k + 1 :] if self.side is None else every[self.side == 0]
            others = others[part[others] != part[k]]
            if not len(others):
                continue
            likely = others[survives(np.broadcast_to(self.sig[k], (len(others), self.sig.shape[1])), self.sig[others])]
            for j in likely.tolist():
                if part[j] != part[k] and (self.sets is None or similar(self.sets[k], self.sets[j])):
                    part[part == part[j]] = part[k]
        heads: dict[int, dict[int, bytes]] = {}
        for k, fp in enumerate(self.fps):  # one member stands for all that were of one part before
            old = heads.setdefault(part[k], {})
            old[first[k]] = min(fp, old.get(first[k], fp))
        for old in heads.values():
            least = min(old.values())
            for fp in old.values():
                if fp != least:
                    yield least, fp


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, side, part, fp, sig[, words]), sorted by key, to the edges of each key's forest."""
    only("minhash")
    waiting: list[tuple] = []
    last = None

    def out(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([x for _, x in found], pa.binary())})

    for batch in (b.slice(at, PIECE) for b in batches for at in range(0, b.num_rows, PIECE)):
        found: list[tuple[bytes, bytes]] = []
        for key, *row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True):
            if key != last and waiting:
                found += _Forest(waiting).edges()
                waiting = []
            last = key
            waiting.append(tuple(row))
        yield out(found)
    if waiting:
        yield out(list(_Forest(waiting).edges()))


def _forests(rows: DataFrame, sizes: DataFrame, group: str, block: int) -> DataFrame:
    """(a, b): forests of the likely pairs, or with ``words`` of the links, within each ``group``.

    ``rows`` has (group, n, fp, sig[, words]), where n is the group's size, as ``sizes`` has
    it.  A group larger than ``block`` is cut into blocks by hash, which are joined up
    within themselves first.  Then only classes outside the group's largest
    component so far meet the group's other blocks: s of those and n rows cost
    about n * s comparisons and n * (1 + s / block) + s * n / block rows, so a
    large group whose members are near copies of each other costs rows in
    proportion to its size.
    """
    columns = ["fp", "sig", *(c for c in rows.columns if c == "words")]
    blocks = F.ceil(F.col("n") / block)
    own = F.pmod(F.xxhash64("fp"), blocks)

    def compared(dealt: DataFrame) -> DataFrame:
        return dealt.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_compared, "a binary, b binary")

    alone = F.lit(None)
    near = saved(compared(rows.select(F.struct(group, own.alias("i"), F.lit(0).alias("j")).alias("key"), alone.cast("int").alias("side"), alone.cast("binary").alias("part"), *columns)))
    if sizes.where(F.col("n") > block).isEmpty():
        return near
    large = rows.where(F.col("n") > block)
    joined = components(near).toDF("fp", "part")
    large = saved(large.join(joined, "fp", "left").withColumn("part", F.coalesce("part", "fp")))
    parts = large.groupBy(group, "part").agg(F.count("*").alias("size"))
    most = saved(parts.groupBy(group).agg(F.max_by("part", F.struct("size", "part")).alias("most"), (F.sum("size") - F.max("size")).alias("rest")).where("rest > 0"))
    large = large.join(most, group)
    chunks = F.ceil(F.col("rest") / block)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    sides = [
        large.withColumns({"i": own, "j": upto(chunks), "side": F.lit(0)}),
        large.where("part <> most").withColumns({"i": upto(blocks), "j": F.pmod(F.xxhash64("fp", F.lit(1)), chunks), "side": F.lit(1)}),
    ]
    far = [x.select(F.struct(group, "i", "j").alias("key"), "side", "part", *columns) for x in sides]
    return saved(near.union(compared(far[0].union(far[1]))))


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, n_shingles, fp) of (doc_id, text_hash, text), and (fp, label): equal labels, one component.

    A label is (doc_id, text_hash) of the component's first row by id, nulls last.
    """
    profiles = saved(docs.mapInArrow(_profile, "doc_id bigint, text_hash bigint, n_shingles bigint, fp binary, sig binary, bands array<bigint>"))
    rows = saved(profiles.drop("sig", "bands"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))
    classes = saved(profiles.where("fp IS NOT NULL").groupBy("fp").agg(first.alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    release(profiles)
    banded = classes.select("fp", F.explode("bands").alias("band"))
    shared = saved(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    member = saved(banded.join(shared, "band"))
    likely = _forests(member.join(classes.select("fp", "sig"), "fp").select("band", "n", "fp", "sig"), shared, "band", BLOCK)
    release(member, shared)

    clusters = saved(components(likely).toDF("fp", "cluster"))
    sizes = saved(clusters.groupBy("cluster").agg(F.count("*").alias("n")))
    placed = saved(clusters.join(classes.select("fp", "rep", "sig"), "fp").join(sizes, "cluster"))
    wanted = placed.select("fp", "rep").alias("p")
    sets = (
        docs.alias("d")
        .join(wanted, F.expr("d.text_hash = p.rep.text_hash AND d.doc_id <=> p.rep.doc_id"))
        .select("p.fp", "d.text")
        .mapInArrow(_sets, "fp binary, words binary")
        .dropDuplicates(["fp"])
    )
    verified = saved(placed.select("cluster", "n", "fp", "sig").join(sets, "fp").select("cluster", "n", "fp", "sig", "words"))
    roots = components(_forests(verified, sizes, "cluster", SET_BLOCK)).toDF("fp", "root")
    led = classes.select("fp", "rep").join(roots, "fp")
    lead = led.groupBy("root").agg(F.min("rep").alias("least"))
    moved = saved(roots.join(lead, "root").select("fp", "least"))
    labels = saved(classes.select("fp", "rep").join(moved, "fp", "left").select("fp", F.coalesce("least", "rep").alias("label")))
    return rows, labels


@scratched
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Null and empty texts, and texts without words, have no shingles and link
    with nothing.  Rows that share an id are judged each by its own text.  A
    null id is no component's id unless all of its rows have none; those are
    kept.  Only the two named columns are read.  An empty table gives an empty
    result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    rows, labels = _labelled(docs)
    found = (
        rows.join(labels, "fp", "left")
        .select("doc_id", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("label.doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
    return saved(found, keep=True)


@scratched
def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest id (nulls last), of its texts the first by hash, of its equal rows any one.

    Rows are judged by id and text, so a row that shares its id with a near copy
    stays if its own text is of another component.  Rows without words (null
    and empty texts among them) all stay.  All columns are returned as they
    are; none may be named ``_near_id`` or ``_near_hash``, which raises
    ``ValueError``.  An empty table gives an empty result.
    """
    if clash := {"_near_id", "_near_hash"}.intersection(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are used inside")
    id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    rows, labels = _labelled(docs.select(id_.alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")))
    key = ["_near_id", "_near_hash"]
    found = (
        rows.join(labels, "fp")
        .groupBy(F.coalesce("doc_id", F.lit(-(1 << 63))).alias(key[0]), F.col("text_hash").alias(key[1]))
        .agg(F.count("*").alias("copies"), F.first((F.col("label.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("label.text_hash") == F.col("text_hash"))).alias("leads"))
    )
    odd = saved(found.where("NOT leads OR copies > 1"), keep=True)
    docs = docs.withColumns({key[0]: F.coalesce(id_, F.lit(-(1 << 63))), key[1]: F.xxhash64(text)})
    alone = docs.join(odd.select(*key), key, "left_anti")
    one = docs.join(odd.where("leads").select(*key), key, "left_semi").dropDuplicates(key)
    return alone.union(one).drop(*key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: shingle count, component and verdict of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
