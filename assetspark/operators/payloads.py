"""Payloads on executors: decoded bytes, pictures, original files, and what a browser shows or downloads.

Each row is decoded where it lies; a fault is a row with ``error_code`` and
``error`` and never ends the query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import deepmap, images
from ..functions.deepmap import ImageError
from ..functions.pixels import png
from ..sources.reader import Catalog
from .catalog import entries
from .references import resolve
from .reports import classified, entry_list, resolved

#: What a payload function looks at.
USED = ("rendition_kind", "encoding", "compression", "width", "height", "components", "raw", "chunks", "sizes", "tlvs")
#: Rows turned at a time; pictures are large.
AT_ONCE = 16
_FAULT = "error_code string, error string"


def _turned(rows: DataFrame, keys: list[str], make: Callable[[dict[str, Any]], dict[str, Any]], fields: str) -> DataFrame:
    """``keys`` of ``rows`` and what ``make`` gives for each whole row, or its fault."""
    made = rows.sparkSession.createDataFrame([], f"{fields}, {_FAULT}").schema
    out = StructType([*(rows.schema[k] for k in keys), *made])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                done = []
                for r in batch.slice(at, AT_ONCE).to_pylist():
                    try:
                        new = make(r)
                    except ImageError as e:
                        new = {"error_code": e.code, "error": str(e)}
                    done.append({k: r[k] for k in keys} | new)
                yield pa.RecordBatch.from_pylist(done, schema=schema)

    return rows.mapInArrow(run, out)


def decoded(catalog: Catalog, limit: int | None = None) -> DataFrame:
    """(archive_id, rend_ord, data, error_code, error): every payload decompressed; ``limit`` bounds each one's bytes."""
    rows = catalog.payloads.select("archive_id", "rend_ord", *USED)
    return _turned(rows, ["archive_id", "rend_ord"], lambda r: {"data": images.decoded(r, limit)}, "data binary")


def _picture(pixels: np.ndarray, form: str, most: int) -> dict[str, Any]:
    if form == "thumbnail":
        pixels = images.thumbnail(pixels, max(1, most))
    if form in ("rgba", "thumbnail"):
        pixels = images.rgba(pixels)
    data = pixels.tobytes() if form == "rgba" else png(pixels)
    return {"p_width": pixels.shape[1], "p_height": pixels.shape[0], "data": data}


def with_sources(catalog: Catalog, rows: DataFrame) -> DataFrame:
    """``rows`` (archive_id, source_ord) with the payload columns of their sources as ``source``."""
    source = catalog.payloads.select("archive_id", F.col("rend_ord").alias("source_ord"), F.struct(*USED).alias("source"))
    return rows.join(source, ["archive_id", "source_ord"], "left")


def listed_sources(catalog: Catalog) -> DataFrame:
    """(archive_id, asset_id, source_ord, crops): what each entry's picture is made of; a reference that fails has no source."""
    way = resolve(catalog).select("archive_id", "rend_ord", F.col("source_ord").alias("led"), F.col("crops"))
    own = entries(catalog).select("archive_id", "asset_id", "rend_ord", "layout").join(way, ["archive_id", "rend_ord"], "left")
    is_ref = F.col("layout") == 1003
    return own.select("archive_id", "asset_id", F.when(is_ref, F.col("led")).otherwise(F.col("rend_ord")).alias("source_ord"), F.when(is_ref, F.col("crops")).alias("crops"))


def pictures(catalog: Catalog, form: str = "rgba", most: int = 256, exif: bool = False, limit: int | None = None, where: Column | None = None) -> DataFrame:
    """(archive_id, asset_id, p_width, p_height, data, error_code, error) of entries.

    ``form``: rgba, png, or thumbnail (a PNG that fits a square of ``most``).
    References give their source with their crops.  ``where`` chooses entries
    before anything is decoded.
    """
    rows = listed_sources(catalog)
    rows = with_sources(catalog, rows if where is None else rows.where(where))

    def make(r: dict[str, Any]) -> dict[str, Any]:
        if r["source"] is None:
            raise ImageError("UnresolvedReference")
        return _picture(images.cropped(images.image(r["source"], limit, exif), r["crops"] or []), form, most)

    return _turned(rows, ["archive_id", "asset_id"], make, "p_width int, p_height int, data binary")


def originals(catalog: Catalog, where: Column | None = None) -> DataFrame:
    """(archive_id, asset_id, data, error_code, error): the files that entries were made of."""
    rows = listed_sources(catalog)
    rows = with_sources(catalog, rows if where is None else rows.where(where))

    def make(r: dict[str, Any]) -> dict[str, Any]:
        if r["source"] is None:
            raise ImageError("UnresolvedReference")
        return {"data": images.original(r["source"])}

    return _turned(rows, ["archive_id", "asset_id"], make, "data binary")


def _browsed(catalog: Catalog, where: Column | None) -> DataFrame:
    """The browser's list with what each row's payload is made of."""
    listed = entry_list(catalog)
    ways = resolved(catalog).select("archive_id", "asset_id", "source_ord", "crops")
    order = classified(catalog).select("archive_id", "asset_id", "entry_index")
    rows = listed.join(order, ["archive_id", "entry_index"]).join(ways, ["archive_id", "asset_id"])
    return with_sources(catalog, rows if where is None else rows.where(where))


_SHOWN = ["archive_id", "id", "mime_type", "suggested_extension", "suggested_file_name", "preserves_original_format", "selection_reason"]


def display_payloads(catalog: Catalog, where: Column | None = None) -> DataFrame:
    """What a browser shows of each listed entry: ``kind`` tells which of the other columns are set.

    img-binary has the file, canvas-rgba its pixels and the entry's size,
    color-swatch the colour; download-only has nothing to show.
    """
    rows = _browsed(catalog, where)

    def make(r: dict[str, Any]) -> dict[str, Any]:
        kind = r["preview_strategy"]
        if kind == "img-binary":
            return {"kind": kind, "data": images.original(r["source"])}
        if kind == "canvas-rgba":
            return {"kind": kind, "data": images.rgba(images.cropped(images.image(r["source"]), r["crops"] or [])).tobytes()}
        return {"kind": kind}

    return _turned(rows, [*_SHOWN, "width", "height", "color_space", "color_components", "css_color"], make, "kind string, data binary")


def download_payloads(catalog: Catalog, where: Column | None = None) -> DataFrame:
    """The file to download of each listed entry; colours have none and give EntryNotDownloadable."""
    rows = _browsed(catalog, where)

    def make(r: dict[str, Any]) -> dict[str, Any]:
        way = r["download_strategy"]
        if way == "original":
            return {"data": images.original(r["source"])}
        if way == "png":
            return {"data": png(images.cropped(images.image(r["source"]), r["crops"] or []))}
        raise ImageError("EntryNotDownloadable")

    return _turned(rows, [*_SHOWN, "download_strategy"], make, "data binary")


def thumbnails(catalog: Catalog, most: int = 256, where: Column | None = None) -> DataFrame:
    """(archive_id, id, mime, data): a small PNG of each picture, vector files as they are; nothing for what has no preview."""
    rows = _browsed(catalog, where)

    def make(r: dict[str, Any]) -> dict[str, Any]:
        if r["preview_strategy"] == "canvas-rgba":
            return {"mime": "image/png"} | _picture(images.rgba(images.cropped(images.image(r["source"]), r["crops"] or [])), "thumbnail", most)
        if r["preview_strategy"] == "img-binary":
            if r["source"]["encoding"] in ("JPEG", "WEBP") and max(r["width"], r["height"]) > most:
                raise ImageError("UnsupportedEncoding", f"no decoder for {r['source']['encoding']}")
            return {"mime": r["mime_type"], "data": images.original(r["source"])}
        return {}

    return _turned(rows, ["archive_id", "id"], make, "mime string, p_width int, p_height int, data binary")


def tiles(catalog: Catalog) -> DataFrame:
    """(archive_id, rend_ord, chunk, position, column, row, width, height, x, y): the tiles of deep-map grids and their places."""
    rows = catalog.payloads.where(F.col("compression") == images.DEEPMAP).select("archive_id", "rend_ord", F.explode("chunks").alias("c"))
    rows = rows.select("archive_id", "rend_ord", F.col("c.no").alias("chunk"), F.col("c.data").alias("data")).where(F.col("data").contains(F.lit(deepmap.TILE)))

    def make(r: dict[str, Any]) -> dict[str, Any]:
        found = []
        for k, t in enumerate(deepmap.tiles(r["data"])):
            head = deepmap.header(t.data)
            found.append({"position": k, "column": t.column, "row": t.row, "width": head.width, "height": t.rows or head.height})
        return {"tiles": found}

    found = _turned(rows, ["archive_id", "rend_ord", "chunk"], make, "tiles array<struct<position:int,column:bigint,row:bigint,width:int,height:int>>")
    each = found.where("error_code IS NULL").select("archive_id", "rend_ord", "chunk", F.inline("tiles"))
    grid = ["archive_id", "rend_ord", "chunk"]
    wide = each.groupBy(*grid, "column").agg(F.max("width").alias("size"))
    high = each.groupBy(*grid, "row").agg(F.max("height").alias("size"))

    def offsets(sizes: DataFrame, axis: str, name: str) -> DataFrame:
        before = Window.partitionBy(*grid).orderBy(axis).rowsBetween(Window.unboundedPreceding, -1)
        return sizes.select(*grid, axis, F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias(name))

    return each.join(offsets(wide, "column", "x"), [*grid, "column"]).join(offsets(high, "row", "y"), [*grid, "row"])
