"""TLV metadata, and the report rows of documents and renditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, terms
from ..functions.terms import number
from ..sources.reader import Catalog
from .catalog import entries
from .references import resolve

#: TLV tags; those of 1004 are read and dropped.
SLICES, METRICS, BLEND, UTI, EXIF, ROW_BYTES, REFERENCE = 1001, 1003, 1004, 1005, 1006, 1007, 1010
KNOWN = (SLICES, METRICS, BLEND, UTI, EXIF, ROW_BYTES, REFERENCE)


def _of(tag: int) -> Column:
    return F.filter("tlvs", lambda t: t["tag"] == tag)


def _last(tag: int, make) -> Column:
    found = _of(tag)
    return F.when(F.size(found) > 0, make(F.element_at(found, -1)["body"]))


def first(tag: int, make) -> Column:
    """What the first TLV with a tag says, or null."""
    return make(F.get(_of(tag), F.lit(0))["body"])


def uti_text(body: Column) -> Column:
    raw = F.substring(body, F.lit(9), number(body).cast("int"))
    return F.rtrim(F.decode(raw, "UTF-8"), F.lit("\0"))


def _rects(body: Column) -> Column:
    rect = lambda k: F.struct(*[number(body, 4 + 16 * k + 4 * i).alias(c) for i, c in enumerate(("x", "y", "width", "height"))])
    count = number(body).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), rect)).otherwise(F.array().cast("array<struct<x:bigint,y:bigint,width:bigint,height:bigint>>"))


def _metrics(body: Column) -> Column:
    pair = lambda at: F.struct(number(body, at).alias("width"), number(body, at + 4).alias("height"))
    return F.struct(pair(4).alias("top_right_inset"), pair(12).alias("bottom_left_inset"), pair(20).alias("image_size"))


def _reference(body: Column) -> Column:
    parts = [number(body, 8 + 4 * k).alias(c) for k, c in enumerate(("x", "y", "width", "height"))]
    return F.struct(*parts, number(body, 24, 2).alias("layout"), number(body, 26).alias("key_byte_len"))


def with_tlv(renditions: DataFrame) -> DataFrame:
    """``tlv``: slices of all TLVs in order; of the others the last counts; and the tags and sizes of unknown ones."""
    unknown = F.transform(F.filter("tlvs", lambda t: ~t["tag"].isin(*KNOWN)), lambda t: F.struct(t["tag"].alias("tag"), F.length(t["body"]).alias("byte_len")))
    return renditions.withColumn(
        "tlv",
        F.struct(
            F.flatten(F.transform(_of(SLICES), lambda t: _rects(t["body"]))).alias("slices"),
            _last(METRICS, _metrics).alias("metrics"),
            _last(UTI, uti_text).alias("uti"),
            _last(EXIF, number).alias("exif_orientation"),
            _last(ROW_BYTES, number).alias("bytes_per_row"),
            _last(REFERENCE, _reference).alias("reference"),
            unknown.alias("unknown"),
        ),
    )


def document_infos(catalog: Catalog) -> DataFrame:
    """The report row of each archive."""
    d = catalog.document
    columns = {
        "AssetStorageVersion": "storage_version", "CoreUIVersion": "coreui_version", "SchemaVersion": "schema_version", "Timestamp": "storage_timestamp",
        "MainVersionString": "main_version", "VersionString": "version_string", "UUID": names.uuid(F.col("uuid")), "ColorSpace": terms.named(F.col("color_space"), terms.COLOR_SPACES, "unknown"),
        "KeySemantics": "key_semantics", "RenditionCount": "rendition_count", "AuthoringTool": "authoring_tool", "DeploymentPlatform": "deployment_platform",
        "DeploymentPlatformVersion": "deployment_version", "ThinningArguments": "thinning_arguments",
    }
    return d.select("archive_id", *[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()])


def payload_info(prefix: str = "") -> dict[str, Column]:
    """Encoding, colour model, flags, type and compression of a rendition.

    The flags' bits count from the high end of each byte.
    """
    c = lambda name: F.col(prefix + name)
    flag = lambda byte, bit: F.shiftright(c("flags"), 8 * byte + bit).bitwiseAND(1) == 1
    return {
        "Encoding": terms.encoding(c("encoding")), "ColorModel": terms.named(c("color_model"), terms.COLOR_MODELS, "Unknown"),
        "Opaque": flag(0, 4), "VectorBased": flag(0, 5), "Flippable": flag(1, 6), "Tintable": flag(1, 5),
        "AssetType": F.when(c("rendition_kind") == "ThemeCBCK", "Image").otherwise(c("rendition_kind")),
        "Compression": F.when(c("compression").isNotNull(), terms.named(c("compression"), terms.COMPRESSIONS, "Unknown")),
    }


def rendition_infos(catalog: Catalog) -> DataFrame:
    """The report row of each entry; the payload's columns are those of what a reference leads to, where it leads anywhere."""
    way = resolve(catalog).where("error IS NULL").select("archive_id", "rend_ord", "source_ord")
    used = ("encoding", "color_model", "flags", "rendition_kind", "compression")
    source = catalog.renditions.select("archive_id", F.col("rend_ord").alias("source_ord"), *[F.col(c).alias("s_" + c) for c in used])
    own = entries(catalog).join(way, ["archive_id", "rend_ord"], "left").withColumn("source_ord", F.coalesce("source_ord", "rend_ord"))
    last = lambda tag: F.element_at(F.filter("attrs", lambda a: a["tag"] == tag), -1)["val"]
    has = lambda tag: F.exists("attrs", lambda a: a["tag"] == tag)
    attributes = {k: F.when(has(t), last(t)) for k, t in terms.REPORTED.items()}
    attributes["Idiom"] = terms.named(attributes["Idiom"], terms.IDIOMS, attributes["Idiom"].cast("string"))
    base = {"Name": F.col("facet_name"), "RenditionName": F.col("rendition_name"), "Width": F.col("width"), "Height": F.col("height"), "Scale": F.col("scale"), "Layout": terms.layout(F.col("layout"))}
    columns = base | payload_info("s_") | attributes
    return own.join(source, ["archive_id", "source_ord"]).select("archive_id", "asset_id", *[v.alias(k) for k, v in columns.items()])


def info_json(catalog: Catalog) -> DataFrame:
    """(archive_id, pos, json): the document's row, then the renditions', as JSON objects without what is null."""
    whole = lambda df: F.to_json(F.struct(*[c for c in df.columns if c not in ("archive_id", "asset_id")]))
    docs, infos = document_infos(catalog), rendition_infos(catalog)
    head = docs.select("archive_id", F.lit(0).cast("long").alias("pos"), whole(docs).alias("json"))
    return head.unionByName(infos.select("archive_id", (F.col("asset_id") + 1).alias("pos"), whole(infos).alias("json")))
