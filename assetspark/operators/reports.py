"""Diagnostics, browser classification and preview pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.names import css_color, extension
from ..sources.reader import Catalog
from .catalog import RASTER, entries
from .export import suggested_name, with_identity
from .references import resolve

#: Compressions that can be decoded, TLV tags that are known.
DECODABLE = (0, 2, 3, 4, 9, 11)
KNOWN_TLVS = (1001, 1003, 1004, 1005, 1006, 1007, 1010)
HEVC = 9


def unsupported_reason() -> Column:
    """Why a rendition has no output, or null; references are never unsupported."""
    kind, enc = F.col("rendition_kind"), F.col("encoding")
    known = enc.isin(*RASTER, "JPEG", "WEBP", "HEIF", "PDF ", "SVG ", "DATA")
    return (
        F.when(F.col("layout") == 1003, F.lit(None).cast("string"))
        .when(kind.isin("Unknown", "None"), F.concat(F.lit("RenditionKind:"), kind))
        .when((kind == "ThemeCBCK") & ~F.coalesce(F.col("compression").isin(*DECODABLE), F.lit(False)), F.concat(F.lit("Compression:"), F.col("compression").cast("string")))
        .when(~known, F.concat(F.lit("Encoding:"), enc))
    )


def diagnostics(catalog: Catalog) -> DataFrame:
    """``entries`` and ``issues``, each issue as its kind and detail."""
    text = lambda k, v: F.concat(F.lit(k + ":"), v)
    unknown = F.filter("tlvs", lambda t: ~t["tag"].isin(*KNOWN_TLVS))
    failed = resolve(catalog).select("archive_id", "rend_ord", "error")
    issues = F.flatten(
        F.array(
            F.array_compact(
                F.array(
                    F.when(F.col("reason").isNotNull(), text("Unsupported", F.col("reason"))),
                    F.when(F.col("rendition_kind") == "Unknown", text("UnknownRendition", F.col("payload_tag"))),
                )
            ),
            F.transform(unknown, lambda t: text("UnknownTlv", t["tag"].cast("string"))),
            F.array_compact(F.array(F.when(F.col("error").isNotNull(), text("UnresolvedReference", F.col("error"))))),
        )
    )
    return entries(catalog).withColumn("reason", unsupported_reason()).join(failed, ["archive_id", "rend_ord"], "left").withColumn("issues", issues)


def diagnostics_totals(catalog: Catalog) -> DataFrame:
    """One row of counters for each archive; facets count also where they are empty."""
    n = lambda kind: F.sum(F.size(F.filter("issues", lambda i: i.startswith(kind + ":")))).cast("long")
    rows = diagnostics(catalog).groupBy("archive_id").agg(
        F.count("*").alias("entries"),
        F.count_if(F.col("reason").isNull()).alias("supported_outputs"),
        F.count_if(F.col("reason").isNotNull()).alias("unsupported_outputs"),
        F.count_if(F.col("layout") == 1003).alias("internal_references"),
        n("UnknownRendition").alias("unknown_renditions"),
        n("UnknownTlv").alias("unknown_tlvs"),
        n("UnresolvedReference").alias("unresolved_references"),
    )
    facets = catalog.facets.groupBy("archive_id").agg(F.count("*").alias("facets"))
    return facets.join(rows, "archive_id", "left").na.fill(0)


def first_issues(catalog: Catalog, limit: int = 50) -> DataFrame:
    """The first issues of each archive in entry order."""
    each = diagnostics(catalog).select("archive_id", "asset_id", "facet_name", "rendition_name", F.posexplode("issues").alias("pos", "issue"))
    order = Window.partitionBy("archive_id").orderBy("asset_id", "pos")
    return each.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def resolved(catalog: Catalog) -> DataFrame:
    """``entries`` with the payload columns of what a reference leads to; others are their own source."""
    way = resolve(catalog).select("archive_id", "rend_ord", "source_ord", "crops", "error")
    source = catalog.renditions.select(
        "archive_id", F.col("rend_ord").alias("source_ord"), F.col("rendition_kind").alias("source_kind"), F.col("encoding").alias("source_encoding"),
        F.col("compression").alias("source_compression"), F.col("color_space").alias("source_space"), F.col("components").alias("source_components"),
        F.col("key_values").alias("source_key"), F.col("rendition_name").alias("source_name"),
    )
    own = entries(catalog).join(way, ["archive_id", "rend_ord"], "left")
    own = own.withColumn("source_ord", F.when(F.col("layout") == 1003, F.col("source_ord")).otherwise(F.col("rend_ord")))
    return own.join(source, ["archive_id", "source_ord"])


def classified(catalog: Catalog) -> DataFrame:
    """What ``_classified`` gives, made once for a catalog."""
    return catalog.derived("classified", lambda: _classified(catalog))


def _classified(catalog: Catalog) -> DataFrame:
    """The rows a browser can list, with how to show and to download them, and ``entry_id``.

    Unresolved references and payloads that cannot be shown are left out before
    ids are dealt.
    """
    kind, enc = F.col("source_kind"), F.col("source_encoding")
    names_ = ("entry_kind", "preview_strategy", "download_strategy", "mime_type", "suggested_extension", "selection_reason")
    way = lambda *v: F.struct(*[(F.lit(x) if isinstance(x, str) else x).alias(n) for x, n in zip(v, names_, strict=True)])
    own = F.lower(extension(F.element_at(F.split("rendition_name", "/"), -1)))
    data_type = F.when(own == "json", "application/json").when(own == "lottie", "application/zip").otherwise("application/octet-stream")
    shown, kept = "original-browser-binary", "download-only-original"
    table = (
        F.when(kind == "Color", way("color", "color-swatch", "none", "", "", "metadata-color"))
        .when(kind.isin("MultisizeImageSet", "None", "Unknown"), None)
        .when(F.col("source_compression") == HEVC, way("image", "download-only", "original", "image/heic", "heic", kept))
        .when(enc == "JPEG", way("image", "img-binary", "original", "image/jpeg", "jpg", shown))
        .when(enc == "WEBP", way("image", "img-binary", "original", "image/webp", "webp", shown))
        .when(enc == "SVG ", way("image", "img-binary", "original", "image/svg+xml", "svg", shown))
        .when(enc == "PDF ", way("document", "download-only", "original", "application/pdf", "pdf", kept))
        .when(enc == "HEIF", way("image", "download-only", "original", "image/heic", "heic", kept))
        .when(enc.isin(*RASTER), way("image", "canvas-rgba", "png", "image/png", "png", "decoded-raster"))
        .when(enc == "DATA", way("raw-data", "download-only", "original", data_type, own, kept))
    )
    order = Window.partitionBy("archive_id").orderBy("asset_id")
    return (
        resolved(catalog).withColumn("_way", table).where("_way IS NOT NULL").select("*", "_way.*").drop("_way")
        .withColumn("entry_index", (F.row_number().over(order) - 1).cast("long"))
    )


def with_preview(listed: DataFrame) -> DataFrame:
    """``preview_index``: a row itself, or for a download-only one its best shown sibling of the same facet and name."""
    group = ["archive_id", "facet_name", "rendition_name"]
    shown = listed.where("preview_strategy <> 'download-only'").select(
        *group, F.struct(F.col("scale").alias("s"), (F.col("width") * F.col("height")).alias("area"), F.col("entry_index").alias("i")).alias("c")
    )
    by_group = shown.groupBy(*group).agg(F.collect_list("c").alias("_c"))
    rank = lambda c: F.struct(F.when(c["s"] == F.col("scale"), 0).when(c["s"] == 1, 1).otherwise(2).alias("r"), c["s"].alias("s"), c["area"].alias("area"), c["i"].alias("i"))
    best = F.array_min(F.transform("_c", rank))["i"]
    own = F.col("preview_strategy") != "download-only"
    return listed.join(by_group, group, "left").withColumn("preview_index", F.when(own, F.col("entry_index")).otherwise(best)).drop("_c")


def entry_list(catalog: Catalog) -> DataFrame:
    """What ``_entry_list`` gives, made once for a catalog."""
    return catalog.derived("entry list", lambda: _entry_list(catalog))


def _entry_list(catalog: Catalog) -> DataFrame:
    """What a browser shows of each listed entry, 21 columns."""
    listed = with_preview(classified(catalog))
    rows = listed.withColumns({"p_rendition_kind": F.col("source_kind"), "p_encoding": F.col("source_encoding"), "p_rendition_name": F.col("source_name"), "p_key": F.col("source_key")})
    rows = with_identity(catalog, rows)
    downloadable = F.col("download_strategy") != "none"
    ending = F.col("suggested_extension")
    fallback = F.when(ending == "", "asset").otherwise(F.concat(F.lit("asset."), ending))
    file = F.coalesce(suggested_name(F.col("identity_name"), F.col("p_kind"), F.col("scale"), ending), fallback)
    is_color = F.col("source_kind") == "Color"
    entry_id = lambda c: F.concat(F.lit("entry-"), F.col(c).cast("string"))
    return rows.select(
        "archive_id", "entry_index", entry_id("entry_index").alias("id"), entry_id("preview_index").alias("preview_source_id"), "facet_name", "rendition_name", "width", "height", "scale",
        terms.layout_kebab(F.col("layout")).alias("logical_layout"), terms.encoding_lower(F.col("source_encoding")).alias("resolved_encoding"),
        "entry_kind", "preview_strategy", "download_strategy", "suggested_extension", F.when(downloadable, file).otherwise("").alias("suggested_file_name"), "mime_type",
        (F.col("download_strategy") != "png").alias("preserves_original_format"), "selection_reason", downloadable.alias("downloadable"),
        F.when(is_color, terms.named(F.col("source_space"), terms.COLOR_SPACES, "unknown")).alias("color_space"),
        F.when(is_color, F.col("source_components")).alias("color_components"),
        F.when(is_color, css_color(F.col("source_space"), F.col("source_components"))).alias("css_color"),
    )


def summaries(listed: DataFrame, images_only: bool = False) -> DataFrame:
    """The shorter rows of a list; with ``images_only`` without raw data and colours."""
    rows = listed.where("entry_kind NOT IN ('raw-data', 'color')") if images_only else listed
    return rows.select(
        "archive_id", "id", "preview_source_id", "facet_name", "rendition_name", "width", "height", "scale", "resolved_encoding", "entry_kind", "preview_strategy", "downloadable", "css_color"
    )


def preview_badge(listed: DataFrame) -> DataFrame:
    """``shown_id``, the entry whose picture stands for a row, and ``badge``: derived, preview, or the strategy's name."""
    derived = F.col("preview_source_id").isNotNull() & (F.col("preview_source_id") != F.col("id"))
    shown = F.col("preview_strategy") != "download-only"
    return listed.withColumns({"shown_id": F.coalesce("preview_source_id", "id"), "badge": F.when(derived, "derived").when(shown, "preview").otherwise(F.col("preview_strategy"))})
