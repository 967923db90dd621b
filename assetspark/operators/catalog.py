"""Entries, variants and what a rendition is."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.reader import Catalog

#: Attribute tags by the name a variant query uses.
ATTRIBUTES = {"scale": 12, "idiom": 15, "display_gamut": 24, "appearance": 7, "localization": 13, "horizontal_size_class": 20, "vertical_size_class": 21}
#: Encodings as stored, in reading order.
RASTER = ("ARGB", "RGBW", "GRAY", "GA16", "GA8 ", "RGB5")
ORIGINAL = ("JPEG", "WEBP", "HEIF", "PDF ", "SVG ")


def named(tag: int) -> Column:
    """The last value of an attribute, or null."""
    found = F.filter("attrs", lambda a: a["tag"] == tag)
    return F.when(F.size(found) > 0, F.element_at(found, -1)["val"])


def scale() -> Column:
    """The first positive scale attribute, else a hundredth of the scale factor."""
    found = F.filter("attrs", lambda a: (a["tag"] == 12) & (a["val"] > 0))
    return F.coalesce(F.get(found, F.lit(0))["val"].cast("long"), F.floor(F.col("scale_factor") / 100))


def asset_kind() -> Column:
    paper = F.col("encoding").isin("PDF ", "SVG ")
    kind = F.col("rendition_kind")
    return (
        F.when(kind == "Color", "Color")
        .when(kind == "RawData", F.when(paper, "Document").otherwise("RawData"))
        .when(kind == "ThemeCBCK", F.when(paper, "Document").otherwise("Image"))
        .when(kind == "MultisizeImageSet", kind)
        .otherwise("Unknown")
    )


def payload_kind() -> Column:
    kind = F.col("rendition_kind")
    return (
        F.when(F.col("layout") == 1003, "Dispatch")
        .when(kind == "Color", "ColorMetadata")
        .when(kind.isin("RawData", "MultisizeImageSet"), "Original")
        .when((kind == "ThemeCBCK") & F.col("encoding").isin(*RASTER), "DecodedRaster")
        .when((kind == "ThemeCBCK") & F.col("encoding").isin(*ORIGINAL), "Original")
        .otherwise("Unsupported")
    )


def items(catalog: Catalog) -> DataFrame:
    """Each facet's renditions; facets without an identifier or renditions vanish."""
    facets = catalog.facets.select("archive_id", "facet_name", "identifier")
    return facets.join(catalog.renditions, ["archive_id", "identifier"])


def entries(catalog: Catalog) -> DataFrame:
    """``items`` with the dense ordinal ``asset_id``, its siblings' count and kinds."""
    return catalog.derived("entries", lambda: _entries(catalog))


def _entries(catalog: Catalog) -> DataFrame:
    order = Window.partitionBy("archive_id").orderBy("facet_name", "rend_ord")
    siblings = Window.partitionBy("archive_id", "facet_name")
    return items(catalog).select(
        "*",
        (F.row_number().over(order) - 1).cast("long").alias("asset_id"),
        F.count("*").over(siblings).alias("variant_count"),
        scale().alias("scale"),
        asset_kind().alias("asset_kind"),
        payload_kind().alias("payload_kind"),
        *[named(tag).alias(f"attr_{name}") for name, tag in ATTRIBUTES.items()],
    )


@dataclass(frozen=True)
class VariantQuery:
    """Wanted attribute values; one left out matches anything, also null."""

    scale: int | None = None
    idiom: int | None = None
    display_gamut: int | None = None
    appearance: int | None = None
    localization: int | None = None
    horizontal_size_class: int | None = None
    vertical_size_class: int | None = None

    def matches(self) -> Column:
        test = F.lit(True)
        for f in fields(self):
            if (want := getattr(self, f.name)) is not None:
                test &= F.col(f"attr_{f.name}").eqNullSafe(F.lit(want))
        return test

    def rank(self) -> Column:
        own = F.coalesce(F.col("attr_scale").cast("long"), F.col("scale"))
        if self.scale is None:
            return F.struct(F.when(own == 1, 0).otherwise(1), own)
        return F.struct(F.when(own == self.scale, 0).otherwise(1), F.when(own == self.scale, own).otherwise(F.abs(own - self.scale)))


def best_variants(listed: DataFrame, query: VariantQuery) -> DataFrame:
    """The best match of each facet: by scale rank, then name, key and ordinal."""
    order = F.struct(query.rank().alias("rank"), "rendition_name", "key_values", "asset_id")
    keep = [c for c in listed.columns if c not in ("archive_id", "facet_name")]
    best = listed.where(query.matches()).groupBy("archive_id", "facet_name").agg(F.min_by(F.struct(*keep), order).alias("best"))
    return best.select("archive_id", "facet_name", "best.*")


def with_key(catalog: Catalog, key: list[int]) -> DataFrame:
    """The first rendition of each archive with exactly this key."""
    found = catalog.renditions.where(F.col("key_values") == F.array(*map(F.lit, key)).cast("array<int>"))
    first = Window.partitionBy("archive_id").orderBy("rend_ord")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def variant_attributes(listed: DataFrame) -> DataFrame:
    """``listed`` with ``all`` attributes and the ``unknown`` ones, whose tags have no name."""
    return listed.withColumn("all", F.col("attrs")).withColumn("unknown", F.filter("attrs", lambda a: ~a["tag"].between(0, 27)))


def search(listed: DataFrame, query: str, encoding: str = "resolved_encoding") -> DataFrame:
    """Listed rows whose id, facet, name or encoding holds the query, whatever the case; all for a blank one."""
    hay = F.lower(F.concat_ws("\n", "id", "facet_name", "rendition_name", encoding))
    needle = query.strip().lower()
    return listed.where(hay.contains(needle)) if needle else listed


def highlighted(text: Column, query: str, before: str = "[", after: str = "]") -> Column:
    """``text`` with each place of the query marked, whatever the case; the query is taken literally."""
    needle = query.strip()
    if not needle:
        return text
    return F.regexp_replace(text, F.lit("(?iu)" + re.escape(needle)), F.lit(re.sub(r"([\\$])", r"\\\1", before) + "$0" + re.sub(r"([\\$])", r"\\\1", after)))


def window(listed: DataFrame, start: int, end: int, overscan: int = 3, order: str = "entry_index") -> DataFrame:
    """Rows ``start`` to ``end`` of each archive's list, and ``overscan`` more on both sides."""
    return listed.where((F.col(order) >= max(0, start - overscan)) & (F.col(order) < end + overscan))
