"""Sinks: the files of an export plan, ZIP files of what a browser lists, and reports as JSON.

Executors write through ``pyarrow.fs``, to any store it knows, first under a
name of their own; a task that is run again writes the same files again.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs as stores
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import images, terms
from ..functions.deepmap import ImageError
from ..functions.pixels import png
from ..operators import metadata, payloads
from ..operators.export import planned
from .reader import Catalog

_OUTCOME = "archive_id string, asset_id bigint, path string, outcome string, error_code string, error string"


def _store(root: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(re.sub("^file:/+", "file:///", root))


def _anew() -> Column:
    """Always true; Spark would take an equal plan that is kept for this one, whatever files there are by now."""
    return F.lit(uuid.uuid4().hex) != ""


def _put(store: stores.FileSystem, path: str, data: bytes) -> None:
    """Writes a file under another name and moves it, so that no half of it is ever seen."""
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.part-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def content(r: dict[str, Any], path: str, crops: list[dict[str, int]]) -> bytes:
    """What a planned file holds: JSON of colours and size lists, originals, or a picture with its crops."""
    kind = r["rendition_kind"]
    if kind == "Color":
        return json.dumps({"colorSpace": terms.COLOR_SPACES.get(r["color_space"], "unknown"), "components": r["components"]}, indent=2).encode()
    if kind == "MultisizeImageSet":
        sizes = [{"height": s["height"], "idiom": terms.IDIOMS.get(s["idiom"], "unknown"), "index": s["index"], "width": s["width"]} for s in r["sizes"]]
        return json.dumps(sizes, indent=2).encode()
    if kind == "RawData" or r["compression"] == images.HEVC or r["encoding"] in ("HEIF", "PDF ", "SVG "):
        return images.original(r)
    pixels = images.cropped(images.image(r), crops)
    if not path.lower().endswith(".png"):
        raise ImageError("UnsupportedEncoding", f"no encoder for {path.rpartition('.')[2]}")
    return png(pixels)


def archive_folder() -> Column:
    """An archive's file name without its ending."""
    return F.regexp_replace(F.element_at(F.split("archive_id", "/"), -1), r"(?<=.)\.[^.]*$", "")


def _present(catalog: Catalog, root: str) -> DataFrame | None:
    """(path): the files under ``root``, relative to it; None if there is no such folder."""
    spark = catalog.archives.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return None
    whole = store.makeQualified(place).toString().rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return found.select(F.expr(f"substring(path, {len(whole) + 1})").alias("file"))


def extract(catalog: Catalog, root: str, overwrite: bool = False, folder: Column | None = None) -> DataFrame:
    """Writes the planned files below ``root`` and returns one row for each entry.

    ``outcome``: Saved, Skipped (no output, an unsafe name, one of equal
    canonical files, or a file that is there already), or Failed with its error.
    Faults that say nothing about other assets are counted; any other one ends
    the query.  Each archive's files lie in ``folder``, by default one of the
    archive's name.
    """
    plan = planned(catalog).withColumn("file", F.concat_ws("/", archive_folder() if folder is None else folder, "path"))
    plan = plan.withColumn("file", F.when(F.col("path").isNotNull(), F.regexp_replace("file", "^/+", "")))
    present = None if overwrite else _present(catalog, root)
    plan = plan.select("archive_id", "asset_id", "source_ord", "file", "crops", "outcome")
    plan = plan.withColumn("there", F.lit(False)) if present is None else plan.join(present.withColumn("there", F.lit(True)), "file", "left")
    plan = plan.where(_anew())
    todo = (F.col("outcome") == "Planned") & F.coalesce(~F.col("there"), F.lit(True))
    source = catalog.payloads.select("archive_id", F.col("rend_ord").alias("source_ord"), F.struct(*payloads.USED, "color_space").alias("source"))
    jobs = plan.where(todo).join(source, ["archive_id", "source_ord"]).select("archive_id", "asset_id", "file", "crops", "source")
    rest = plan.where(~todo).select("archive_id", "asset_id", F.col("file").alias("path"), F.lit("Skipped").alias("outcome"), F.when(F.col("outcome") != "Planned", F.col("outcome")).alias("error_code"), F.lit(None).cast("string").alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(root)
        for batch in batches:
            for at in range(0, batch.num_rows, payloads.AT_ONCE):
                done = []
                for r in batch.slice(at, payloads.AT_ONCE).to_pylist():
                    row = {"archive_id": r["archive_id"], "asset_id": r["asset_id"], "path": r["file"], "outcome": "Saved", "error_code": None, "error": None}
                    try:
                        _put(store, f"{top.rstrip('/')}/{r['file']}", content(r["source"], r["file"], r["crops"] or []))
                    except ImageError as e:
                        if not images.recoverable(e.code):
                            raise
                        row |= {"outcome": "Failed", "error_code": e.code, "error": str(e)}
                    done.append(row)
                cols = {k: [d[k] for d in done] for k in row}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k == "asset_id" else pa.string()) for k, v in cols.items()})

    out = jobs.mapInArrow(run, _OUTCOME).unionByName(rest).persist(StorageLevel.MEMORY_AND_DISK)
    out.count()  # the files are written now, and once
    return out


def extract_summary(outcomes: DataFrame) -> DataFrame:
    """Saved, skipped and failed entries of each archive."""
    n = lambda what: F.count_if(F.col("outcome") == what).alias(what.lower())
    # equal canonical files are one output, so the others count as neither
    return outcomes.where("error_code IS NULL OR error_code <> 'Coalesced'").groupBy("archive_id").agg(n("Saved"), n("Skipped"), n("Failed"))


def plain_name(name: str) -> str:
    """A file name without what file systems do not take."""
    return re.sub(r'[\\/:*?"<>|]+', "_", name).strip() or "asset.bin"


def free_name(name: str, taken: set[str]) -> str:
    """``name`` or, if that is taken, with (2), (3), ... before its ending; it is taken afterwards."""
    name = plain_name(name)
    dot = name.rfind(".")
    stem, ending = (name[:dot], name[dot:]) if 0 < dot < len(name) - 1 else (name, "")
    out, k = name, 1
    while out in taken:
        k += 1
        out = f"{stem} ({k}){ending}"
    taken.add(out)
    return out


def zip_name(source: str | None) -> str:
    """The name of the ZIP file of an archive."""
    source = (source or "").strip()
    dot = source.rfind(".")
    return f"{plain_name(source[:dot] if dot > 0 else source)}-assets.zip" if source else "car-assets.zip"


def write_zips(catalog: Catalog, root: str, where: Column | None = None) -> DataFrame:
    """One ZIP file below ``root`` for each archive, of all its listed files, stored as they are.

    Returns (archive_id, zip, id, name, error_code): entries without a file, such
    as colours, keep their error and are left out.  A file is written by one
    task, entry after entry, and never held whole.
    """
    index = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    found = payloads.download_payloads(catalog, where).select("archive_id", "id", "suggested_file_name", "data", "error_code", index.alias("n"))
    found = found.where(_anew()).repartition("archive_id").sortWithinPartitions("archive_id", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(root)
        store.create_dir(top, recursive=True)
        open_: dict[str, Any] = {}

        def close() -> None:
            if open_:
                open_["zip"].close()
                open_["out"].close()
                store.move(open_["part"], f"{top.rstrip('/')}/{open_['name']}")
                open_.clear()

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if open_.get("archive") != r["archive_id"]:
                    close()
                    name = zip_name(r["archive_id"].rpartition("/")[2])
                    part = f"{top.rstrip('/')}/{name}.part-{uuid.uuid4().hex}"
                    out = store.open_output_stream(part)
                    open_.update(archive=r["archive_id"], name=name, part=part, out=out, zip=zipfile.ZipFile(out, "w", zipfile.ZIP_STORED), taken=set())
                entry = None
                if r["error_code"] is None:
                    entry = free_name(r["suggested_file_name"] or r["id"], open_["taken"])
                    open_["zip"].writestr(zipfile.ZipInfo(entry, (1980, 1, 1, 0, 0, 0)), r["data"])
                done.append((r["archive_id"], open_["name"], r["id"], entry, r["error_code"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)] if done else [pa.array([], pa.string())] * 5, names=["archive_id", "zip", "id", "name", "error_code"])
        close()

    out = found.mapInArrow(run, "archive_id string, zip string, id string, name string, error_code string").persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


def write_info(catalog: Catalog, root: str) -> None:
    """The report of each archive as JSON lines in order, in one folder for each archive below ``root``."""
    rows = metadata.info_json(catalog).withColumn("archive", archive_folder())
    rows.repartition("archive").sortWithinPartitions("archive", "pos").select("archive", F.col("json").alias("value")).write.mode("overwrite").partitionBy("archive").text(root)
