"""The catalog queries over sample archives, and the same in SQL over the tables they were made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import catalog as C
from ..operators import export, metadata, references, reports
from . import pictures
from .samples import SQL, catalog

ID = ["archive_id", "asset_id"]
Query = Callable[[SparkSession, str], DataFrame]


def _attr(tag: int):
    return F.filter("attrs", lambda a: a["tag"] == tag)[0]["val"].cast("long")


def _best(query: C.VariantQuery) -> Query:
    return lambda s, d: C.best_variants(C.entries(catalog(s, d)), query).select("archive_id", "facet_name", "asset_id", "rendition_name", "scale")


def _best_sql(rank: str, where: str = "true") -> str:
    return SQL + f"""SELECT archive_id, facet_name, arg_min(asset_id, k) AS asset_id, arg_min(rendition_name, k) AS rendition_name, arg_min(scale, k) AS scale
      FROM (SELECT *, ({rank}, rendition_name, [p, scale, idiom, gamut], asset_id) AS k FROM r WHERE {where}) GROUP BY ALL"""


def queries() -> dict[str, Query]:
    cat = catalog
    return {
        "scan_document": lambda s, d: cat(s, d).document.select(
            "archive_id", "coreui_version", "storage_version", "schema_version", "rendition_count", "deployment_version", "deployment_platform", names.uuid(F.col("uuid")).alias("uuid")
        ),
        "key_format": lambda s, d: cat(s, d).key_format.select("archive_id", F.col("pos").cast("long").alias("pos"), F.col("attr_tag").cast("long").alias("attr_tag")),
        "scan_appearances": lambda s, d: cat(s, d).appearances.select("archive_id", "name", F.length("value").cast("long").alias("size")),
        "scan_facets": lambda s, d: cat(s, d).facets.select("archive_id", "facet_name", F.col("identifier").cast("long").alias("identifier"), F.size("attrs").cast("long").alias("n_attrs")),
        "scan_renditions": lambda s, d: cat(s, d).renditions.select(
            "archive_id", "rend_ord", F.col("identifier").cast("long").alias("identifier"), "width", "height", "scale_factor", "encoding", "layout", "rendition_name", "rendition_kind",
            "compression", (184 + F.col("tlv_length") + F.col("rendition_length")).alias("size_on_disk"),
        ),
        "scan_tlv": lambda s, d: cat(s, d).renditions.select("archive_id", "rend_ord", F.explode("tlvs").alias("t")).select("archive_id", "rend_ord", F.col("t.tag").alias("tag"), F.length("t.body").cast("long").alias("size")),
        "scan_chunks": lambda s, d: cat(s, d).payloads.where("compression = 0").select("archive_id", "rend_ord", F.posexplode("chunks").alias("no", "c")).select(
            "archive_id", "rend_ord", F.col("no").cast("long").alias("no"), F.md5("c.data").alias("md5")
        ),
        "scan_raw": lambda s, d: cat(s, d).payloads.where("rendition_kind = 'RawData'").select("archive_id", "rend_ord", F.md5("raw").alias("md5"), F.length("raw").cast("long").alias("size")),
        "scan_sizes": lambda s, d: cat(s, d).renditions.select("archive_id", "rend_ord", F.explode("sizes").alias("z")).select("archive_id", "rend_ord", F.col("z.width").alias("width"), F.col("z.height").alias("height"), F.col("z.idiom").cast("long").alias("idiom")),
        "entries": lambda s, d: C.entries(cat(s, d)).select(*ID, "facet_name", "rendition_name", "rend_ord", "width", "height", "scale", "variant_count", "asset_kind", "payload_kind"),
        "entry_by_id": lambda s, d: C.entries(cat(s, d)).where("asset_id = 7").select(*ID, "facet_name", "rendition_name"),
        "variants_for_name": lambda s, d: C.entries(cat(s, d)).where(F.col("facet_name").endswith("#7")).select(*ID, "facet_name", "rendition_name", "scale"),
        "variant_attributes": lambda s, d: C.entries(cat(s, d)).select(*ID, *[F.col(f"attr_{a}").cast("long").alias(a) for a in ("scale", "idiom", "display_gamut", "appearance")]),
        "raw_attribute": lambda s, d: C.entries(cat(s, d)).select(*ID, _attr(15).alias("idiom"), _attr(24).alias("gamut")),
        "best_variant_default": _best(C.VariantQuery()),
        "best_variant_scale2": _best(C.VariantQuery(scale=2)),
        "best_variant_multi": _best(C.VariantQuery(scale=3, idiom=2, display_gamut=1)),
        "best_variant_null": _best(C.VariantQuery(appearance=0)),
        "exact_key_lookup": lambda s, d: C.with_key(cat(s, d), [10, 2, 1, 0]).select("archive_id", "rend_ord", "rendition_name"),
        "tlv_view": lambda s, d: cat(s, d).renditions.select("archive_id", "rend_ord", metadata.first(metadata.EXIF, metadata.number).alias("exif")),
        "tlv_metadata": lambda s, d: metadata.with_tlv(cat(s, d).renditions).select(
            "archive_id", "rend_ord", F.col("tlv.exif_orientation").alias("exif"), F.col("tlv.bytes_per_row").alias("row_bytes"), F.size("tlv.slices").cast("long").alias("n_slices"),
            F.try_element_at(F.col("tlv.slices.x"), F.lit(-1)).alias("last_x"), F.col("tlv.uti").alias("uti"), F.col("tlv.metrics.image_size.width").alias("metric_width"),
            F.col("tlv.reference.key_byte_len").alias("key_bytes"), F.array_join(F.transform("tlv.unknown", lambda u: F.concat_ws(":", u["tag"], u["byte_len"])), ",").alias("unknown"),
        ),
        "document_info": lambda s, d: metadata.document_infos(cat(s, d)).select("archive_id", "AssetStorageVersion", "CoreUIVersion", "SchemaVersion", "Timestamp", "ColorSpace", "KeySemantics", "RenditionCount", "AuthoringTool", "DeploymentPlatform", "DeploymentPlatformVersion", "ThinningArguments", "UUID"),
        "rendition_infos": lambda s, d: metadata.rendition_infos(cat(s, d)).select(
            "archive_id", "asset_id", F.col("Name").alias("name"), F.col("Layout").alias("layout"), F.col("Encoding").alias("encoding"), F.col("ColorModel").alias("color_model"),
            F.col("AssetType").alias("asset_type"), F.col("Compression").alias("compression"), F.col("Opaque").alias("opaque"), F.col("Idiom").alias("idiom"), F.col("AttributeScale").cast("long").alias("attribute_scale"), F.col("DisplayGamut").cast("long").alias("display_gamut"), F.col("Element").cast("long").alias("element"),
        ),
        "resolve_refs": lambda s, d: references.resolve(cat(s, d)).where("error IS NULL").select("archive_id", "rend_ord", "source_ord", F.col("hops").cast("long").alias("hops")),
        "resolve_ref_errors": lambda s, d: references.resolve(cat(s, d)).where("error IS NOT NULL").groupBy("archive_id", "error").agg(F.count("*").alias("n")),
        "ref_crops": lambda s, d: references.resolve(cat(s, d)).where("error IS NULL").select("archive_id", "rend_ord", F.size("crops").cast("long").alias("n_crops"), F.element_at("crops", -1)["x"].alias("outer_x"), F.element_at("crops", -1)["width"].alias("outer_width"), F.col("effective_layout").cast("long").alias("layout")),
        "asset_kinds": lambda s, d: C.entries(cat(s, d)).groupBy("archive_id", "asset_kind", "payload_kind").agg(F.count("*").alias("n")),
        "diagnostics_entries": lambda s, d: reports.diagnostics(cat(s, d)).select(*ID, F.array_join("issues", ",").alias("issues")),
        "diagnostics_totals": lambda s, d: reports.diagnostics_totals(cat(s, d)),
        "diagnostics_top50": lambda s, d: reports.first_issues(cat(s, d)).select(*ID, F.col("pos").cast("long").alias("pos"), "issue"),
        "entry_list": lambda s, d: reports.entry_list(cat(s, d)).select("archive_id", "id", "facet_name", "logical_layout", "resolved_encoding", "suggested_extension", "suggested_file_name", "mime_type", "preserves_original_format", "selection_reason", "downloadable", "color_space", "css_color"),
        "image_summaries": lambda s, d: reports.summaries(reports.entry_list(cat(s, d)), images_only=True).select("archive_id", "id", "entry_kind", "preview_source_id"),
        "preview_badge": lambda s, d: reports.preview_badge(reports.entry_list(cat(s, d))).groupBy("archive_id", "badge").agg(F.count("*").alias("n")),
        "classify": lambda s, d: reports.classified(cat(s, d)).select("archive_id", "entry_index", "facet_name", "entry_kind", "preview_strategy", "download_strategy", "mime_type"),
        "list_images": lambda s, d: reports.classified(cat(s, d)).where("entry_kind NOT IN ('raw-data', 'color')").groupBy("archive_id").agg(F.count("*").alias("n")),
        "preview_pairing": lambda s, d: reports.with_preview(reports.classified(cat(s, d))).select("archive_id", "entry_index", "preview_index"),
        "search": lambda s, d: C.search(reports.entry_list(cat(s, d)), " .PDF ").select("archive_id", "id", "rendition_name"),
        "search_id": lambda s, d: C.search(reports.entry_list(cat(s, d)), " Entry-1 ").select("archive_id", "id", "rendition_name"),
        "list_window": lambda s, d: C.window(reports.entry_list(cat(s, d)), 10, 20).select("archive_id", "id"),
        "css_color": lambda s, d: cat(s, d).renditions.where("rendition_kind = 'Color'").select("archive_id", "rend_ord", names.css_color(F.col("color_space"), F.col("components")).alias("css")),
        "output_identity": lambda s, d: C.entries(cat(s, d)).select(*ID, export.identity_kind().alias("identity")),
        "export_plan": lambda s, d: export.planned(cat(s, d)).select(*ID, "outcome", "path", F.when(F.col("path").isNotNull(), F.col("format")).alias("format")),
        "canonical_coalesced": lambda s, d: export.planned(cat(s, d)).groupBy("archive_id", "outcome").agg(F.count("*").alias("n")),
        **pictures.queries(),
    }


_KINDS = """CASE WHEN rendition_kind = 'Color' THEN 'Color' WHEN rendition_kind = 'RawData' THEN CASE WHEN encoding = 'DATA' THEN 'RawData' ELSE 'Document' END
  WHEN rendition_kind = 'ThemeCBCK' THEN 'Image' WHEN rendition_kind = 'MultisizeImageSet' THEN rendition_kind ELSE 'Unknown' END AS asset_kind,
  CASE kind WHEN 3 THEN 'Dispatch' WHEN 0 THEN 'ColorMetadata' WHEN 1 THEN 'DecodedRaster' WHEN 2 THEN 'Original' WHEN 4 THEN 'Original' ELSE 'Unsupported' END AS payload_kind"""
_REASON = """CASE WHEN kind = 3 THEN NULL WHEN kind = 5 THEN 'RenditionKind:Unknown' WHEN kind = 6 THEN 'RenditionKind:None'
  WHEN kind = 1 AND compression NOT IN (0, 2) THEN 'Compression:' || compression WHEN encoding = 'None' THEN 'Encoding:None' END"""
_ISSUES = SQL + f""", d AS (SELECT r.*, {_REASON} AS reason, w.error FROM r LEFT JOIN way w USING (archive_id, rend_ord)),
  i AS (SELECT *, list_filter(['Unsupported:' || reason, CASE WHEN kind = 5 THEN 'UnknownRendition:QQQQ' END, CASE WHEN p % 10 = 0 THEN 'UnknownTlv:4242' END, 'UnresolvedReference:' || error], lambda x: x IS NOT NULL) AS issues FROM d)
"""
_CLAMP = "greatest(0.0, least(1.0, {}))"
_LO, _HI = _CLAMP.format("lo"), _CLAMP.format("hi")
_CSS = f"""CASE p % 4 WHEN 1 THEN 'rgba(' || CAST(floor({_LO} * 255 + 0.5) AS BIGINT) || ', ' || CAST(floor({_LO} * 255 + 0.5) AS BIGINT) || ', ' || CAST(floor({_LO} * 255 + 0.5) AS BIGINT) || ', ' || printf('%.4f', {_HI}) || ')'
  WHEN 3 THEN 'rgba(' || CAST(floor({_LO} * 255 + 0.5) AS BIGINT) || ', ' || CAST(floor({_LO} * 255 + 0.5) AS BIGINT) || ', ' || CAST(floor({_LO} * 255 + 0.5) AS BIGINT) || ', ' || printf('%.4f', {_HI}) || ')'
  WHEN 2 THEN 'color(display-p3 ' || printf('%.4f', {_LO}) || ' ' || printf('%.4f', {_HI}) || ' 0.5000 / 1.0000)'
  ELSE 'rgba(' || CAST(floor({_LO} * 255 + 0.5) AS BIGINT) || ', ' || CAST(floor({_HI} * 255 + 0.5) AS BIGINT) || ', 128, 1.0000)' END"""
_SHOWN = SQL + f""", c AS (SELECT r.archive_id, r.asset_id, r.facet_name, r.rendition_name, r.scale, r.size, r.layout, t.kind AS k, t.encoding AS e, t.rendition_name AS t_name, t.css, t.space,
      lower(regexp_extract(r.rendition_name, '[^/][.]([^./]*)$', 1)) AS own_ext
    FROM r LEFT JOIN way w USING (archive_id, rend_ord)
    JOIN (SELECT *, {_CSS} AS css, ['srgb', 'gray-gamma-2.2', 'display-p3', 'extended-gray'][p % 4 + 1] AS space FROM r) t
      ON t.archive_id = r.archive_id AND t.rend_ord = CASE WHEN r.kind = 3 THEN CASE WHEN w.error IS NULL THEN w.stop_ord END ELSE r.rend_ord END
    WHERE t.kind IN (0, 1, 2)),
  s AS (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY asset_id) - 1 AS entry_index,
    CASE WHEN k = 0 THEN 'color' WHEN k = 1 OR e = 'SVG ' THEN 'image' WHEN e = 'PDF ' THEN 'document' ELSE 'raw-data' END AS entry_kind,
    CASE WHEN k = 0 THEN 'color-swatch' WHEN k = 1 THEN 'canvas-rgba' WHEN e = 'SVG ' THEN 'img-binary' ELSE 'download-only' END AS preview_strategy,
    CASE WHEN k = 0 THEN 'none' WHEN k = 1 THEN 'png' ELSE 'original' END AS download_strategy,
    CASE WHEN k = 0 THEN '' WHEN k = 1 THEN 'image/png' WHEN e = 'SVG ' THEN 'image/svg+xml' WHEN e = 'PDF ' THEN 'application/pdf' WHEN own_ext = 'json' THEN 'application/json' WHEN own_ext = 'lottie' THEN 'application/zip'
      ELSE 'application/octet-stream' END AS mime_type,
    CASE WHEN k = 0 THEN '' WHEN k = 1 THEN 'png' WHEN e = 'SVG ' THEN 'svg' WHEN e = 'PDF ' THEN 'pdf' ELSE own_ext END AS suggested_extension FROM c),
  v AS (SELECT x.archive_id, x.entry_index, CASE WHEN any_value(x.preview_strategy) <> 'download-only' THEN x.entry_index ELSE arg_min(y.entry_index,
      (CASE WHEN y.scale = x.scale THEN 0 WHEN y.scale = 1 THEN 1 ELSE 2 END, y.scale, 2 * y.size * y.size, y.entry_index)) END AS preview_index
    FROM s x LEFT JOIN s y ON x.archive_id = y.archive_id AND x.facet_name = y.facet_name AND x.rendition_name = y.rendition_name AND y.preview_strategy <> 'download-only' GROUP BY x.archive_id, x.entry_index, x.scale)
"""
_PLAN = SQL + """, own AS (SELECT *, CASE WHEN kind = 2 THEN 'canonical' WHEN kind IN (0, 1, 4) THEN 'variant' END AS own_kind FROM r),
  back AS (SELECT archive_id, facet_name, rendition_name, min(rend_ord) AS backup FROM own WHERE own_kind IS NOT NULL GROUP BY ALL),
  j AS (SELECT o.*, CASE WHEN o.own_kind IS NOT NULL THEN o.rend_ord WHEN o.kind = 3 THEN CASE WHEN w.error IS NULL THEN w.stop_ord ELSE b.backup END END AS src
    FROM own o LEFT JOIN way w USING (archive_id, rend_ord) LEFT JOIN back b USING (archive_id, facet_name, rendition_name)),
  k AS (SELECT j.archive_id, j.asset_id, j.facet_name, j.rendition_name, j.scale, CASE WHEN t.kind IN (0, 1, 2, 4) THEN t.kind END AS pk, t.encoding AS pe, t.facet_name AS f2, t.rendition_name AS n2, t.rend_ord AS t_ord,
    row_number() OVER (PARTITION BY j.archive_id, t.rend_ord, CASE WHEN t.kind = 2 THEN -1 ELSE j.asset_id END ORDER BY j.asset_id) AS nth FROM j LEFT JOIN r t ON t.archive_id = j.archive_id AND t.rend_ord = j.src),
  m AS (SELECT *, CASE WHEN pk = 2 THEN f2 ELSE facet_name END AS f, CASE WHEN pk = 2 THEN n2 ELSE rendition_name END AS raw_name, CASE WHEN pk <> 2 AND scale > 1 THEN '@' || scale || 'x' ELSE '' END AS sfx FROM k),
  o AS (SELECT *, regexp_replace(raw_name, '^.*/', '') AS nm, f LIKE '../%' OR raw_name LIKE '../%' AS unsafe FROM m),
  q AS (SELECT *, CASE WHEN pk IS NULL THEN 'UnsupportedPayload' WHEN pk = 2 AND nth > 1 THEN 'Coalesced' WHEN unsafe THEN 'UnsafeFileName' ELSE 'Planned' END AS outcome FROM o),
  u AS (SELECT *, CASE WHEN outcome = 'Planned' THEN f || '/' || CASE WHEN pk IN (0, 4) THEN nm || sfx || '.json' WHEN pk = 2 THEN nm ELSE regexp_replace(nm, '[.]png$', '') || sfx || '.png' END END AS base_path FROM q),
  n AS (SELECT *, row_number() OVER (PARTITION BY archive_id, base_path, outcome ORDER BY asset_id) - 1 AS c FROM u)
"""


def oracle_sql() -> dict[str, str]:
    tlv_size = """8 + 4 + 8 + 4 + CASE WHEN p % 10 = 0 THEN 9 ELSE 0 END + CASE p % 6 WHEN 0 THEN 12 WHEN 1 THEN 56 WHEN 2 THEN 27 WHEN 3 THEN 36 ELSE 0 END
      + CASE WHEN kind <> 3 OR fault = 'MissingReferenceTlv' THEN 0 WHEN fault = 'UnknownAttribute' THEN 8 + 30 + 8 WHEN fault = 'MalformedKey' THEN 8 + 30 + 23 ELSE 8 + 30 + 20 END"""
    body = "CASE kind WHEN 0 THEN 16 + 32 WHEN 1 THEN CASE WHEN compression = 2 THEN NULL WHEN compression = 0 AND p % 3 = 0 THEN 56 + length(p || ':' || ln) ELSE 16 + length(p || ':' || ln) END WHEN 2 THEN 12 + length(p || ':' || ln) WHEN 4 THEN 24 WHEN 5 THEN 12 + length(p || ':' || ln) ELSE 0 END"
    tlv = lambda tag, size, where="true": f"SELECT archive_id, rend_ord, {tag} AS tag, {size} AS size FROM r WHERE {where}"
    scan_tlv = " UNION ALL ".join([
        tlv(1007, 4), tlv(1006, 4), tlv(4242, 1, "p % 10 = 0"), tlv(1006, 4, "p % 6 = 0"), tlv(1001, 20, "p % 6 = 1"), tlv(1001, 20, "p % 6 = 1"), tlv(1005, 19, "p % 6 = 2"), tlv(1003, 28, "p % 6 = 3"),
        tlv(1010, "CASE fault WHEN 'UnknownAttribute' THEN 38 WHEN 'MalformedKey' THEN 53 ELSE 50 END", "kind = 3 AND coalesce(fault, '') <> 'MissingReferenceTlv'"),
    ])
    return {
        "scan_document": SQL + "SELECT archive_id, 971 AS coreui_version, 17 AS storage_version, 2 AS schema_version, count(*) AS rendition_count, '15.0' AS deployment_version, 'ios' AS deployment_platform, '00000000-0000-0000-0000-000000000000' AS uuid FROM r GROUP BY archive_id",
        "key_format": SQL + "SELECT a.archive_id, k.pos, k.attr_tag FROM (SELECT DISTINCT archive_id FROM r) a, (VALUES (0, 17), (1, 12), (2, 15), (3, 24)) k(pos, attr_tag)",
        "scan_appearances": SQL + "SELECT DISTINCT archive_id, 'UIAppearanceAny' AS name, 2 AS size FROM r",
        "scan_facets": SQL + "SELECT DISTINCT archive_id, facet_name, q AS identifier, 2 AS n_attrs FROM r",
        "scan_tlv": SQL + scan_tlv,
        "scan_chunks": SQL + "SELECT archive_id, rend_ord, 0 AS no, md5(CASE WHEN p % 3 = 0 THEN substr(p || ':' || ln, 1, 2) ELSE p || ':' || ln END) AS md5 FROM r WHERE compression = 0 UNION ALL SELECT archive_id, rend_ord, 1, md5(substr(p || ':' || ln, 3)) FROM r WHERE compression = 0 AND p % 3 = 0",
        "scan_raw": SQL + "SELECT archive_id, rend_ord, md5(p || ':' || ln) AS md5, length(p || ':' || ln) AS size FROM r WHERE kind = 2",
        "scan_sizes": SQL + "SELECT archive_id, rend_ord, size AS width, 2 * size AS height, idiom FROM r WHERE kind = 4",
        "entries": SQL + f"SELECT archive_id, asset_id, facet_name, rendition_name, rend_ord, size AS width, 2 * size AS height, scale, count(*) OVER (PARTITION BY archive_id, facet_name) AS variant_count, {_KINDS} FROM r",
        "entry_by_id": SQL + "SELECT archive_id, asset_id, facet_name, rendition_name FROM r WHERE asset_id = 7",
        "variants_for_name": SQL + "SELECT archive_id, asset_id, facet_name, rendition_name, scale FROM r WHERE facet_name LIKE '%#7'",
        "variant_attributes": SQL + "SELECT archive_id, asset_id, scale, idiom, gamut AS display_gamut, CAST(NULL AS BIGINT) AS appearance FROM r",
        "raw_attribute": SQL + "SELECT archive_id, asset_id, idiom, gamut FROM r",
        "best_variant_default": _best_sql("CASE WHEN scale = 1 THEN 0 ELSE 1 END, scale"),
        "best_variant_scale2": _best_sql("0, scale", "scale = 2"),
        "best_variant_multi": _best_sql("0, scale", "scale = 3 AND idiom = 2 AND gamut = 1"),
        "best_variant_null": _best_sql("0, scale", "false"),
        "exact_key_lookup": SQL + "SELECT archive_id, min(rend_ord) AS rend_ord, arg_min(rendition_name, rend_ord) AS rendition_name FROM r WHERE q = 10 AND scale = 2 AND idiom = 1 AND gamut = 0 GROUP BY archive_id",
        "tlv_view": SQL + "SELECT archive_id, rend_ord, ln AS exif FROM r",
        "tlv_metadata": SQL + """SELECT archive_id, rend_ord, CASE WHEN p % 6 = 0 THEN ln + 1 ELSE ln END AS exif, 4 * size AS row_bytes, CASE WHEN p % 6 = 1 THEN 2 ELSE 0 END AS n_slices, CASE WHEN p % 6 = 1 THEN ln END AS last_x,
          CASE WHEN p % 6 = 2 THEN 'public.png' END AS uti, CASE WHEN p % 6 = 3 THEN size END AS metric_width,
          CASE WHEN kind = 3 THEN CASE fault WHEN 'MissingReferenceTlv' THEN NULL WHEN 'UnknownAttribute' THEN 8 WHEN 'MalformedKey' THEN 23 ELSE 20 END END AS key_bytes, CASE WHEN p % 10 = 0 THEN '4242:1' ELSE '' END AS unknown FROM r""",
        "document_info": SQL + """SELECT archive_id, 17 AS "AssetStorageVersion", 971 AS "CoreUIVersion", 2 AS "SchemaVersion", 0 AS "Timestamp", 'srgb' AS "ColorSpace", 2 AS "KeySemantics", count(*) AS "RenditionCount", 'tool' AS "AuthoringTool",
          'ios' AS "DeploymentPlatform", '15.0' AS "DeploymentPlatformVersion", '' AS "ThinningArguments", '00000000-0000-0000-0000-000000000000' AS "UUID" FROM r GROUP BY archive_id""",
        "rendition_infos": SQL + """SELECT r.archive_id, r.asset_id, r.facet_name AS name, CASE r.kind WHEN 0 THEN 'Color' WHEN 2 THEN 'Data' WHEN 3 THEN 'InternalReference' WHEN 4 THEN 'MultisizeImage' ELSE 'OnePartScale' END AS layout,
          CASE t.encoding WHEN 'DATA' THEN 'Data' WHEN 'PDF ' THEN 'PDF' WHEN 'SVG ' THEN 'SVG' ELSE t.encoding END AS encoding, 'RGB' AS color_model,
          CASE t.rendition_kind WHEN 'ThemeCBCK' THEN 'Image' ELSE t.rendition_kind END AS asset_type, CASE t.compression WHEN 0 THEN 'Uncompressed' WHEN 1 THEN 'RLE' WHEN 2 THEN 'Zip' WHEN 8 THEN 'PaletteImg' END AS compression, false AS opaque,
          ['universal', 'phone', 'pad', 'tv', 'car', 'watch', 'marketing'][r.idiom + 1] AS idiom, r.scale AS attribute_scale, r.gamut AS display_gamut, CAST(NULL AS BIGINT) AS element
          FROM r LEFT JOIN way w ON w.archive_id = r.archive_id AND w.rend_ord = r.rend_ord AND w.error IS NULL JOIN r t ON t.archive_id = r.archive_id AND t.rend_ord = coalesce(w.stop_ord, r.rend_ord)""",
        "resolve_refs": SQL + "SELECT archive_id, rend_ord, stop_ord AS source_ord, hops FROM way WHERE error IS NULL",
        "resolve_ref_errors": SQL + "SELECT archive_id, error, count(*) AS n FROM way WHERE error IS NOT NULL GROUP BY ALL",
        "ref_crops": SQL + "SELECT archive_id, rend_ord, hops AS n_crops, ln AS outer_x, size AS outer_width, 12 AS layout FROM way JOIN r USING (archive_id, rend_ord) WHERE error IS NULL",
        "asset_kinds": SQL + f"SELECT archive_id, asset_kind, payload_kind, count(*) AS n FROM (SELECT archive_id, {_KINDS} FROM r) GROUP BY ALL",
        "scan_renditions": SQL + f"SELECT archive_id, rend_ord, q AS identifier, size AS width, 2 * size AS height, 100 * scale AS scale_factor, encoding, layout, rendition_name, rendition_kind, compression, CASE WHEN compression = 2 THEN 184 + {tlv_size} + 16 + 8 + length(p || ':' || ln) ELSE 184 + {tlv_size} + {body} END AS size_on_disk FROM r",
        "diagnostics_entries": _ISSUES + "SELECT archive_id, asset_id, array_to_string(issues, ',') AS issues FROM i",
        "diagnostics_totals": _ISSUES + "SELECT archive_id, count(DISTINCT facet_name) AS facets, count(*) AS entries, count_if(reason IS NULL) AS supported_outputs, count_if(reason IS NOT NULL) AS unsupported_outputs, count_if(kind = 3) AS internal_references, count_if(kind = 5) AS unknown_renditions, count_if(p % 10 = 0) AS unknown_tlvs, count_if(error IS NOT NULL) AS unresolved_references FROM i GROUP BY archive_id",
        "diagnostics_top50": _ISSUES + "SELECT archive_id, asset_id, pos - 1 AS pos, issues[pos] AS issue FROM (SELECT archive_id, asset_id, issues, unnest(range(1, len(issues) + 1)) AS pos FROM i) QUALIFY row_number() OVER (PARTITION BY archive_id ORDER BY asset_id, pos) <= 50",
        "classify": _SHOWN + "SELECT archive_id, entry_index, facet_name, entry_kind, preview_strategy, download_strategy, mime_type FROM s",
        "list_images": _SHOWN + "SELECT archive_id, count(*) AS n FROM s WHERE entry_kind NOT IN ('raw-data', 'color') GROUP BY archive_id",
        "preview_pairing": _SHOWN + "SELECT archive_id, entry_index, preview_index FROM v",
        "search": _SHOWN + "SELECT archive_id, 'entry-' || entry_index AS id, rendition_name FROM s WHERE lower(rendition_name) LIKE '%.pdf%'",
        "search_id": _SHOWN + "SELECT archive_id, 'entry-' || entry_index AS id, rendition_name FROM s WHERE CAST(entry_index AS VARCHAR) LIKE '1%'",
        "list_window": _SHOWN + "SELECT archive_id, 'entry-' || entry_index AS id FROM s WHERE entry_index >= 7 AND entry_index < 23",
        "entry_list": _SHOWN + """SELECT archive_id, 'entry-' || entry_index AS id, facet_name, CASE layout WHEN 1009 THEN 'color' WHEN 1000 THEN 'data' WHEN 1003 THEN 'internal-reference' ELSE 'one-part-scale' END AS logical_layout,
          lower(trim(e)) AS resolved_encoding, suggested_extension,
          CASE WHEN k = 0 THEN '' WHEN k = 1 THEN CASE WHEN rendition_name LIKE '../%' THEN 'asset.png' ELSE regexp_replace(rendition_name, '[.]png$', '') || CASE WHEN scale > 1 THEN '@' || scale || 'x' ELSE '' END || '.png' END
            WHEN suggested_extension = '' OR lower(regexp_extract(t_name, '[^/][.]([^./]*)$', 1)) = suggested_extension THEN t_name ELSE regexp_replace(t_name, '[.][^.]*$', '') || '.' || suggested_extension END AS suggested_file_name,
          mime_type, k <> 1 AS preserves_original_format, CASE WHEN k = 0 THEN 'metadata-color' WHEN k = 1 THEN 'decoded-raster' WHEN e = 'SVG ' THEN 'original-browser-binary' ELSE 'download-only-original' END AS selection_reason,
          k <> 0 AS downloadable, CASE WHEN k = 0 THEN space END AS color_space, CASE WHEN k = 0 THEN css END AS css_color FROM s""",
        "image_summaries": _SHOWN + "SELECT s.archive_id, 'entry-' || entry_index AS id, entry_kind, 'entry-' || preview_index AS preview_source_id FROM s JOIN v USING (archive_id, entry_index) WHERE entry_kind IN ('image', 'document')",
        "preview_badge": _SHOWN + "SELECT archive_id, CASE WHEN preview_index <> entry_index THEN 'derived' WHEN preview_strategy <> 'download-only' THEN 'preview' ELSE preview_strategy END AS badge, count(*) AS n FROM s JOIN v USING (archive_id, entry_index) GROUP BY ALL",
        "css_color": SQL + f"SELECT archive_id, rend_ord, {_CSS} AS css FROM r WHERE kind = 0",
        "output_identity": SQL + "SELECT archive_id, asset_id, CASE WHEN kind = 2 THEN 'canonical' WHEN kind IN (0, 1, 4) THEN 'variant' END AS identity FROM r",
        "export_plan": _PLAN + "SELECT archive_id, asset_id, outcome, CASE WHEN c = 0 OR base_path IS NULL THEN base_path ELSE regexp_replace(base_path, '[.]([^.]*)$', '_' || c || '.\\1') END AS path, CASE WHEN base_path IS NULL THEN NULL WHEN pk IN (0, 4) THEN 'json' WHEN pk = 2 THEN 'raw' ELSE 'image' END AS format FROM n",
        "canonical_coalesced": _PLAN + "SELECT archive_id, outcome, count(*) AS n FROM n GROUP BY ALL",
        **pictures.oracle_sql(),
    }
