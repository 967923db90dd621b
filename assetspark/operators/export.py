"""The export plan: which rendition is written where."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.names import extension, file_name, relative_path, with_extension
from ..sources.reader import Catalog
from .catalog import entries
from .references import resolve

#: File extension by encoding.
RAW_EXTENSIONS = {"HEIF": "heic", "PDF ": "pdf", "SVG ": "svg", "JPEG": "jpg", "WEBP": "webp"}
HEVC = 9


def identity_kind(prefix: str = "") -> Column:
    """canonical for plain files, variant for what depends on the variant, null for the rest."""
    kind, enc = F.col(prefix + "rendition_kind"), F.col(prefix + "encoding")
    return F.when((kind == "RawData") & enc.isin("DATA", "PDF ", "SVG "), "canonical").when(kind.isin("Color", "ThemeCBCK", "MultisizeImageSet", "RawData"), "variant")


def saved_raw(prefix: str = "") -> Column:
    """Whether a raster is written as the file it holds."""
    return F.coalesce(F.col(prefix + "compression") == HEVC, F.lit(False)) | F.col(prefix + "encoding").isin("HEIF", "PDF ", "SVG ")


def with_identity(catalog: Catalog, rows: DataFrame) -> DataFrame:
    """``rows`` with the facet and name that their payload (p_ columns) is written under.

    A canonical output belongs to the first facet that lists an item with its
    key, a variant to the row itself.
    """
    listed = entries(catalog).withColumn("own_kind", identity_kind()).where("own_kind IS NOT NULL")
    owners = listed.groupBy("archive_id", F.col("key_values").alias("p_key")).agg(
        F.min_by(F.struct(F.col("facet_name").alias("o_facet"), F.col("rendition_name").alias("o_name")), "asset_id").alias("o")
    )
    found = (F.col("p_kind") == "canonical") & F.col("o").isNotNull()
    return rows.withColumn("p_kind", identity_kind("p_")).join(owners, ["archive_id", "p_key"], "left").withColumns(
        {
            "identity_facet": F.when(found, F.col("o.o_facet")).otherwise(F.col("facet_name")),
            "identity_name": F.when(found, F.col("o.o_name")).otherwise(F.when(F.col("p_kind") == "canonical", F.col("p_rendition_name")).otherwise(F.col("rendition_name"))),
        }
    ).drop("o")


def payloads_of(catalog: Catalog) -> DataFrame:
    """The columns of a payload that a plan looks at, by (archive_id, source_ord)."""
    used = ("rendition_kind", "rendition_name", "encoding", "compression")
    return catalog.renditions.select("archive_id", F.col("rend_ord").alias("source_ord"), *[F.col(c).alias("p_" + c) for c in used], F.col("key_values").alias("p_key"))


def suffix(kind: Column, scale: Column) -> Column:
    return F.when((kind == "variant") & (scale > 1), F.concat(F.lit("@"), scale.cast("string"), F.lit("x"))).otherwise("")


def suggested_name(name: Column, kind: Column, scale: Column, ending: Column) -> Column:
    """A file name with the scale before its extension, and with that ending; null for an unsafe one."""
    return with_extension(file_name(name), suffix(kind, scale), ending)


def planned(catalog: Catalog) -> DataFrame:
    """What ``_planned`` gives, made once for a catalog."""
    return catalog.derived("plan", lambda: _planned(catalog))


def _planned(catalog: Catalog) -> DataFrame:
    """``entries`` with identity, payload, crops, ``format``, ``outcome`` and ``path``.

    An item that has an output is its own payload, also if it is a reference.
    Another reference takes what it leads to; only if it leads nowhere, the first
    other item of its facet that has its name and an output.  Of equal canonical
    keys the first in order stays.  Paths that clash get ``_1``, ``_2``, ...
    """
    own = entries(catalog).withColumn("own_kind", identity_kind())
    way = resolve(catalog).select("archive_id", "rend_ord", "source_ord", "crops", "error")
    backup = own.where("own_kind IS NOT NULL").groupBy("archive_id", "facet_name", "rendition_name").agg(F.min("rend_ord").alias("backup"))
    led = F.when(F.col("layout") == 1003, F.when(F.col("error").isNull(), F.col("source_ord")).otherwise(F.col("backup")))
    rows = (
        own.join(way, ["archive_id", "rend_ord"], "left").join(backup, ["archive_id", "facet_name", "rendition_name"], "left")
        .withColumn("crops", F.when(F.col("own_kind").isNull(), F.col("crops")))
        .withColumn("source_ord", F.when(F.col("own_kind").isNotNull(), F.col("rend_ord")).otherwise(led))
        .join(payloads_of(catalog), ["archive_id", "source_ord"], "left")
    )
    rows = with_identity(catalog, rows)
    canonical = F.col("p_kind") == "canonical"
    first = Window.partitionBy("archive_id", F.when(canonical, F.col("p_key")), F.when(canonical, F.lit(-1)).otherwise(F.col("asset_id"))).orderBy("asset_id")
    rows = rows.withColumn("_nth", F.when(canonical, F.row_number().over(first)).otherwise(1))
    json = F.col("p_rendition_kind").isin("Color", "MultisizeImageSet")
    own_ext = F.lower(extension(F.col("identity_name")))
    ending = (
        F.when(F.col("p_rendition_kind") == "RawData", extension(F.col("identity_name")))
        .when(saved_raw("p_"), F.when(F.col("p_compression") == HEVC, "heic").otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in RAW_EXTENSIONS.items() for x in kv]), F.col("p_encoding"))))
        .when(own_ext.isin("png", "jpg", "jpeg", "webp"), own_ext)
        .otherwise("png")
    )
    mark = suffix(F.col("p_kind"), F.col("scale"))
    safe = file_name(F.col("identity_name"))
    name = F.when(json, F.concat(safe, F.when(safe.endswith(mark), "").otherwise(mark), F.lit(".json"))).otherwise(with_extension(safe, mark, ending))
    folder = relative_path(F.col("identity_facet"))
    rows = rows.withColumn("base_path", F.when(folder.isNotNull() & name.isNotNull(), F.concat_ws("/", folder, name)))
    rows_ = rows.withColumn("format", F.when(json, "json").when((F.col("p_rendition_kind") == "RawData") | saved_raw("p_"), "raw").otherwise("image"))
    outcome = (
        F.when(F.col("p_kind").isNull(), "UnsupportedPayload").when(F.col("_nth") > 1, "Coalesced").when(F.col("base_path").isNull(), "UnsafeFileName").otherwise("Planned")
    )
    rows = catalog.derived("plan without paths", lambda: rows_.withColumn("outcome", outcome).drop("_nth"))
    return unique_paths(rows, F.col("outcome") == "Planned")


def _numbered(path: str, n: int) -> str:
    folder, slash, name = path.rpartition("/")
    stem, dot, ext = name.rpartition(".")
    return f"{folder}{slash}{stem}_{n}.{ext}" if stem and dot else f"{path}_{n}"


def _assigned(group: pd.DataFrame) -> pd.DataFrame:
    """Paths in order; one that is taken gets the next number of its own that is free."""
    group = group.sort_values("asset_id")
    counts: dict[str, int] = {}
    taken: set[str] = set()
    out = []
    for base in group["base_path"]:
        path = base
        while path in taken:
            counts[base] = counts.get(base, 0) + 1
            path = _numbered(base, counts[base])
        taken.add(path)
        out.append(path)
    return group.assign(path=out)


def unique_paths(rows: DataFrame, live: Column) -> DataFrame:
    """``rows`` with ``path``: the base paths of the ``live`` ones, made unique within each archive in order of ``asset_id``.

    Mostly the nth row of a path just gets its number.  Only in folders where a
    path so made is another row's own, the rows are gone through in order.
    """
    rows = rows.withColumn("_live", live).withColumn("_base", F.when(F.col("_live"), F.col("base_path")))
    order = Window.partitionBy("archive_id", "_base").orderBy("asset_id")
    nth = F.row_number().over(order) - 1
    stem, ext = F.regexp_replace("_base", r"(?<=[^/])\.[^./]*$", ""), extension(F.col("_base"))
    made = F.concat(stem, F.lit("_"), nth.cast("string"), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))
    rows = rows.withColumn("path", F.when(nth == 0, F.col("_base")).otherwise(made)).withColumn("_folder", F.regexp_extract("_base", "^(.*/)[^/]*$", 1))
    again = rows.where("_live AND path <> _base").select("archive_id", "path", "_folder")
    own = rows.where("_live").select("archive_id", F.col("_base").alias("path")).distinct()
    clash = again.join(own, ["archive_id", "path"]).select("archive_id", "_folder").distinct().withColumn("_clash", F.lit(True))
    slow = rows.where("_live").select("archive_id", "_folder", "asset_id", F.col("_base").alias("base_path")).join(clash, ["archive_id", "_folder"], "left_semi")
    kept = slow.select("archive_id", "_folder", "asset_id", "base_path")
    fixed = kept.groupBy("archive_id", "_folder").applyInPandas(_assigned, StructType([*kept.schema.fields, StructField("path", StringType())]))
    fixed = fixed.select("archive_id", "asset_id", F.col("path").alias("_path"))
    out = rows.join(fixed, ["archive_id", "asset_id"], "left")
    return out.withColumn("path", F.when(F.col("_live"), F.coalesce("_path", "path"))).drop("_live", "_base", "_folder", "_path")
