"""Connected components as repeated contraction with DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Edges that one task contracts to the end; more are contracted round by round until so few are left.
FINISH = 200_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) to (node, root) of all nodes; the root is a component's least node."""
    root: dict = {}
    kind = None

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = sorted((find(a), find(b)))
            root[b] = a
    if kind is not None:
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["node", "root"])


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for each node of ``edges``; equal roots mean one component.

    Each round every node joins the neighbour (or itself) that ranks first, and
    edges are rewritten to what their ends joined.  Nodes rank by id in the first
    round, which ends stars about their least node, and later by hashes that
    change by round, which leave an expected constant fraction of the nodes; so
    long paths and stars alike take logarithmically many rounds.  At most
    ``FINISH`` edges are left to one task.  Neighbourhoods are reduced by
    map-side minima and never collected.  The edges of a hub meet its new name
    in a sort-merge join, whose large partitions AQE splits; without AQE they
    are one task's.  Null ends and loops are ignored.
    """
    live = saved(
        edges.select(F.col(left).alias("a"), F.col(right).alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    kind = live.schema["a"].dataType.simpleString()
    steps: list[DataFrame] = []
    while (size := live.count()) > FINISH:
        salt = len(steps)
        rank = lambda c: F.struct((F.xxhash64(F.col(c), F.lit(salt)) if salt else F.lit(0)).alias("h"), F.col(c).alias("id"))
        both = live.select("a", "b").union(live.select(F.col("b"), F.col("a")))
        joined = saved(
            both.groupBy("a")
            .agg(F.min(rank("b")).alias("m"))
            .select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["id"].alias("root"))
        )
        steps.append(joined)
        live = saved(
            live.join(joined.withColumnsRenamed({"node": "a", "root": "ra"}), "a")
            .join(joined.withColumnsRenamed({"node": "b", "root": "rb"}), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
    if size:
        steps.append(saved(live.coalesce(1).mapInArrow(_united, f"node {kind}, root {kind}")))
    if not steps:
        return edges.select(F.col(left).alias("node"), F.col(left).alias("root")).where("false")
    out = steps[0]
    for step in steps[1:]:
        out = (
            out.join(step.toDF("root", "next"), "root", "left")
            .select("node", F.coalesce("next", "root").alias("root"))
        )
    return saved(out) if len(steps) > 1 else out
