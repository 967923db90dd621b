"""Internal references, followed by doubling: sixteen hops take four joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.reader import Catalog

HOPS = 16


def resolve(catalog: Catalog) -> DataFrame:
    """What ``_resolve`` gives, made once for a catalog."""
    return catalog.derived("references", lambda: _resolve(catalog))


def _resolve(catalog: Catalog) -> DataFrame:
    """(archive_id, rend_ord, source_ord, crops, effective_layout, hops, error) of each reference.

    The source is the first rendition on the way that is no reference.  Errors:
    UnknownAttribute, MalformedKey, MissingReferenceTlv, TargetNotFound,
    Cycle, DepthLimit.  Crops come innermost first; the layout is that of the
    outermost reference.
    """
    base = catalog.renditions.select("archive_id", "rend_ord", "key_values", "layout", "reference")
    first = base.groupBy("archive_id", F.col("key_values").alias("key")).agg(F.min("rend_ord").alias("target"))
    is_ref = F.col("layout") == 1003
    hop = base.withColumn("key", F.when(is_ref, F.col("reference.key"))).join(first, ["archive_id", "key"], "left")
    rect = F.struct("reference.x", "reference.y", "reference.width", "reference.height")
    none = F.array().cast("array<bigint>")
    error = (
        F.when(~is_ref, F.lit(None).cast("string"))
        .when(F.col("reference").isNull(), "MissingReferenceTlv")
        .when(F.col("reference.error").isNotNull(), F.col("reference.error"))
        .when(F.col("target").isNull(), "TargetNotFound")
    )
    state = hop.select(
        "archive_id",
        F.col("rend_ord").alias("start"),
        F.coalesce("target", "rend_ord").alias("at"),
        F.when(F.col("target").isNotNull(), F.array("target")).otherwise(none).alias("path"),
        F.when(F.col("target").isNotNull(), F.array(rect)).otherwise(F.array().cast("array<struct<x:bigint,y:bigint,width:bigint,height:bigint>>")).alias("crops"),
        error.alias("error"),
        is_ref.alias("is_ref"),
        F.when(is_ref, F.col("reference.layout")).alias("outer_layout"),
        # no more hops from here: a plain rendition, or a reference that fails
        (~is_ref | error.isNotNull()).alias("ends"),
    )
    for step in range(HOPS.bit_length() - 1):
        # each step uses the one before twice, so that plans would double too
        state = catalog.derived(f"references after {2**step}", lambda made=state: made)
        ahead = state.select("archive_id", F.col("start").alias("at"), F.col("at").alias("at2"), F.col("path").alias("path2"), F.col("crops").alias("crops2"), F.col("error").alias("error2"), F.col("ends").alias("ends2"))
        go = ~F.col("ends")
        state = state.join(ahead, ["archive_id", "at"]).select(
            "archive_id", "start", F.when(go, F.col("at2")).otherwise(F.col("at")).alias("at"),
            F.when(go, F.concat("path", "path2")).otherwise(F.col("path")).alias("path"),
            F.when(go, F.concat("crops2", "crops")).otherwise(F.col("crops")).alias("crops"),
            F.coalesce("error", F.when(go, F.col("error2"))).alias("error"),
            "is_ref", "outer_layout",
            (F.col("ends") | F.col("ends2")).alias("ends"),
        )
    # a state ends when the rendition it stands at is plain or failing; one more look tells
    last = catalog.renditions.select("archive_id", F.col("rend_ord").alias("at"), (F.col("layout") == 1003).alias("still"), F.col("reference").isNull().alias("bare"))
    looped = F.size(F.array_distinct("path")) < F.size("path")
    return (
        state.where("is_ref")
        .join(last, ["archive_id", "at"])
        .withColumn("error", F.coalesce(F.when(F.col("still") & looped, "Cycle"), "error", F.when(F.col("still"), F.when(F.col("bare"), "MissingReferenceTlv").otherwise("DepthLimit"))))
        .select(
            "archive_id", F.col("start").alias("rend_ord"),
            F.when(F.col("error").isNull(), F.col("at")).alias("source_ord"),
            F.when(F.col("error").isNull(), F.col("crops")).alias("crops"),
            F.when(F.col("error").isNull(), F.col("outer_layout")).alias("effective_layout"),
            F.size("path").alias("hops"), "error",
        )
    )
