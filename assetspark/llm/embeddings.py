"""Embedding near-dedup by collision-counting projections (operator 1).

Equal vectors of one label count as one.  The others are cut into blocks of
bounded size along one projection, and by hash where values tie.
For a pair of blocks, each of ``PROJECTIONS`` Gaussian projections is sorted and
every vector opens a window centred on its own value; a pair that falls into
enough windows is verified by its cosine in double precision.  Window and count
are set so that a pair exactly at the threshold falls short with probability
below ``MISS``; closer pairs collide more often.  Pairs of blocks whose values
on the first projection, a unit one, lie further apart than the threshold
allows are never formed.

Each block pair yields counts and a spanning forest of its links, never the
links themselves, so a large group of near copies stays linear in output.  The
pairs of blocks of one label grow with the square of its distinct vectors.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, scratched, table
from .graph import components

COSINE = 0.93
#: Vectors of a block; projections; window half-width in distances at the threshold; miss probability.
BLOCK, PROJECTIONS, WIDTH, MISS = 4096, 32, 1.5, 1e-7
#: Cosines computed at a time; vectors whose collisions are counted at a time; bins along the first projection.
CHUNK, ROWS, BINS = 1 << 16, 512, 256


@lru_cache(maxsize=8)
def _directions(dim: int) -> np.ndarray:
    return np.random.default_rng(17).standard_normal((PROJECTIONS, dim)).astype(np.float32)


@lru_cache(maxsize=8)
def calibrated(cosine: float) -> tuple[float, int]:
    """Half-width of a window and the collisions that keep a pair."""
    distance = math.sqrt(2 - 2 * cosine)
    hit = math.erf(WIDTH / math.sqrt(2))
    below, k = 0.0, 0
    while (below := below + math.comb(PROJECTIONS, k) * hit**k * (1 - hit) ** (PROJECTIONS - k)) < MISS:
        k += 1
    return WIDTH * distance * (1 + 1e-5), k


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def collisions(px: np.ndarray, py: np.ndarray, width: float) -> np.ndarray:
    """How many projections put each pair into a query-centred window."""
    counts = np.zeros((len(px), len(py)), np.uint8)
    spot = np.arange(len(py))
    for k in range(px.shape[1]):
        order = np.argsort(py[:, k], kind="stable")
        values = py[order, k]
        low = np.searchsorted(values, px[:, k] - width, "left")
        high = np.searchsorted(values, px[:, k] + width, "right")
        rank = np.empty(len(py), np.int32)
        rank[order] = spot
        counts += (rank >= low[:, None].astype(np.int32)) & (rank < high[:, None].astype(np.int32))
    return counts


def linked(x: np.ndarray, y: np.ndarray, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two blocks' vectors with at least this cosine."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    width, least = calibrated(cosine)
    to = _directions(x.shape[1]).T
    px, py = (x / nx[:, None]).astype(np.float32) @ to, (y / ny[:, None]).astype(np.float32) @ to
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for row in range(0, len(x), ROWS):
        at, by = np.nonzero(collisions(px[row : row + ROWS], py, width) >= least)
        at += row
        if same:
            at, by = at[at < by], by[at < by]
        for k in range(0, len(at), CHUNK):
            i, j = at[k : k + CHUNK], by[k : k + CHUNK]
            keep = np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j]) >= cosine
            found.append((i[keep], j[keep]))
    none = np.empty(0, np.int64)
    return tuple(np.concatenate([none, *some]) for some in (zip(*found, strict=True) if found else ([], [])))


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each index."""
    root = np.arange(n)
    while True:
        old = root.copy()
        np.minimum.at(root, u, root[v])
        np.minimum.at(root, v, root[u])
        root = root[root]
        if (root == old).all():
            return root


@scratched
def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per id.

    Vectors link only under equal, non-null labels and equal dimensions.  A
    vector that is null, empty or zero, or holds null or non-finite components,
    links with nothing.  Of rows that repeat an id the one with the smallest
    label and vector counts.  Other columns are not read; an empty table gives
    an empty result.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    whole = F.struct("label", F.size("v").alias("dim"), F.xxhash64("v").alias("h"), F.xxhash64("v", F.lit(1)).alias("g"), "v", (F.element_at("v", 1) / F.sqrt(norm)).alias("p"))
    good = F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", fine)
    rows = saved(rows.select("vec_id", F.when(good, F.when((norm > 0) & (norm < float("inf")), whole)).alias("r")))
    equal = ["label", "dim", "h", "g"]
    members = rows.where("r IS NOT NULL").select("vec_id", *[F.col("r").getField(c).alias(c) for c in equal])
    # 128 bits of hash stand for equal vectors
    classes = saved(
        rows.where("r IS NOT NULL").select("vec_id", "r.*").groupBy(*equal)
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("v").alias("v"), F.min("p").alias("p"))
    )
    # the first coordinate of the unit vector is a unit projection; bins are its quantiles
    cuts = saved(
        classes.groupBy("label", "dim")
        .agg(F.percentile_approx("p", F.array(*[F.lit(k / BINS) for k in range(1, BINS)]), 10_000).alias("q"), F.ceil(F.count("*") / BLOCK).alias("n"))
    )
    # labels are few against vectors: their quantiles are joined by size, not by hint
    bins = F.least(F.col("n"), F.lit(BINS))
    binned = classes.join(cuts, ["label", "dim"]).select(*classes.columns, F.floor(F.size(F.filter("q", lambda q: q < F.col("p"))) * bins / BINS).alias("bin"))
    binned = saved(binned)
    # values that tie share a bin of any size, so bins are cut by hash
    shares = saved(binned.groupBy("label", "dim", "bin").agg(F.ceil(F.count("*") / BLOCK).alias("shares")))
    placed = saved(
        binned.join(shares, ["label", "dim", "bin"])
        .select("rep", "copies", "label", "dim", "v", "p", (F.col("bin") * (1 << 40) + F.pmod(F.xxhash64("h", "g"), F.col("shares"))).alias("block"))
    )
    ends = saved(placed.groupBy("label", "dim", "block").agg(F.min("p").alias("lo"), F.max("p").alias("hi")))
    near = math.sqrt(2 - 2 * cosine) * (1 + 1e-9)
    pairs = saved(
        ends.alias("x").join(ends.alias("y"), ["label", "dim"])
        .where((F.col("x.block") <= F.col("y.block")) & (F.col("x.lo") - F.col("y.hi") <= near) & (F.col("y.lo") - F.col("x.hi") <= near))
        .select("label", "dim", F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    )
    sides = pairs.select("label", "dim", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    # one deal by block pair: the rows of each pair are at most two blocks
    dealt = placed.drop("p").join(sides, ["label", "dim", "block"])

    def count(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        order = np.argsort(group.column("rep").to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        block, copies = group.column("block").to_numpy(), group.column("copies").to_numpy()
        keys, data = group.column("rep").to_numpy(), _matrix(group.column("v"))
        left, right = np.nonzero(block == i)[0], np.nonzero(block == j)[0]
        u, w = linked(data[left], data[right], i == j, cosine)
        u, w = left[u], right[w]
        n = np.bincount(u, copies[w], len(keys)) + np.bincount(w, copies[u], len(keys))
        root = _forest(len(keys), u, w)
        some = np.nonzero(n)[0]
        return pa.table({"rep": keys[some], "n": n[some].astype(np.int64), "peer": keys[root[some]]})

    key = rows.schema["vec_id"].dataType.simpleString()
    found = saved(dealt.groupBy("label", "dim", "i", "j").applyInArrow(count, f"rep {key}, n bigint, peer {key}"))
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found, "rep", "peer").toDF("rep", "root")
    least = roots.groupBy("root").agg(F.min("rep").alias("least"))
    of_class = (
        classes.select(*equal, "rep", "copies")
        .join(links, "rep", "left").join(roots.join(least, "root").select("rep", "least"), "rep", "left")
        .select(*equal, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    )
    linked_ = members.join(of_class, equal).select("vec_id", "n_links", "component_id")
    alone = rows.where("r IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked_.union(alone).withColumn("component_id", F.col("component_id").cast("long")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
    return saved(out, keep=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: links and component of every vector."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
