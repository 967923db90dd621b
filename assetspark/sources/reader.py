"""Archives as a small relational schema."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .archive import parse
from .bom import StoreError

_ATTRS = "array<struct<tag:int,val:int>>"
DOCUMENT = (
    "coreui_version bigint, storage_version bigint, storage_timestamp bigint, rendition_count bigint, main_version string, version_string string, uuid binary, "
    "checksum bigint, schema_version bigint, color_space bigint, key_semantics bigint, thinning_arguments string, deployment_version string, deployment_platform string, authoring_tool string"
)
FACET = f"facet_name string, x int, y int, attrs {_ATTRS}, identifier int"
RENDITION = (
    f"rend_ord bigint, key_values array<int>, identifier int, attrs {_ATTRS}, version bigint, flags bigint, width bigint, height bigint, scale_factor bigint, encoding string, "
    "color_model bigint, modification_time bigint, layout bigint, rendition_name string, tlvs array<struct<tag:bigint,body:binary>>, tlv_length bigint, rendition_length bigint, "
    "reference struct<x:bigint,y:bigint,width:bigint,height:bigint,layout:int,key:array<int>,error:string>, rendition_kind string, compression bigint, color_space bigint, "
    "components array<double>, raw binary, chunks array<struct<no:int,height:bigint,data:binary>>, sizes array<struct<width:bigint,height:bigint,index:int,idiom:int>>, payload_tag string"
)


PARTS = {
    "document": f"struct<{DOCUMENT}>", "key_format": "array<int>", "appearance": "struct<name string, value binary>",
    "facet": f"struct<{FACET}>", "rendition": f"struct<{RENDITION}>",
}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive_id, content) of the files under ``path``, by Spark's own reader."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive_id"), "content")


def records(archives: DataFrame, parts: tuple[str, ...] = tuple(PARTS), payloads: bool = False) -> DataFrame:
    """(archive_id, error, and a column for each of ``parts``): one row for each record, with its part's column set.

    Each archive is parsed once, where it lies.  Payload bytes stay out unless
    asked for.  An archive that cannot be read gives one row with its error.
    """
    out = archives.sparkSession.createDataFrame([], f"archive_id string, error string, {', '.join(f'{p} {PARTS[p]}' for p in parts)}").schema
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found = parse(content.as_buffer(), parts, payloads)
                    rows = [{"archive_id": name, part: r} for part in parts for r in found[part]]
                except (StoreError, struct.error) as e:
                    rows = [{"archive_id": name, "error": f"{getattr(e, 'code', 'Truncated')}: {e}"}]
                for at in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 4096], schema=schema)

    return archives.select(F.col("archive_id").cast("string"), "content").mapInArrow(run, out)


@dataclass(frozen=True)
class Catalog:
    """The tables of a set of archives (``archive_id``, ``content``).

    The archives are parsed once; what is found, but for the payloads' bytes, is
    kept by Spark in memory and on disk until ``close``.  So are a few tables that
    many queries use several times each, which keeps their plans small.
    """

    archives: DataFrame
    _kept: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Catalog:
        return cls(read_archives(spark, path))

    def derived(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of that name, made once and kept."""
        if name not in self._kept:
            self._kept[name] = make().persist(StorageLevel.MEMORY_AND_DISK)
        return self._kept[name]

    @property
    def records(self) -> DataFrame:
        # Spark takes plans over the same folder for equal, whatever files it has by now
        return self.derived("records", lambda: records(self.archives.where(F.lit(uuid.uuid4().hex) != "")))

    def close(self) -> None:
        """Drops what was kept."""
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()

    def _part(self, part: str) -> DataFrame:
        return self.records.where(F.col(part).isNotNull()).select("archive_id", f"{part}.*")

    @cached_property
    def errors(self) -> DataFrame:
        """(archive_id, error) of the archives that cannot be read."""
        return self.records.where("error IS NOT NULL").select("archive_id", "error")

    @cached_property
    def document(self) -> DataFrame:
        return self._part("document")

    @cached_property
    def key_format(self) -> DataFrame:
        """(archive_id, pos, attr_tag)."""
        return self.records.where("key_format IS NOT NULL").select("archive_id", F.posexplode("key_format").alias("pos", "attr_tag"))

    @cached_property
    def appearances(self) -> DataFrame:
        return self._part("appearance")

    @cached_property
    def facets(self) -> DataFrame:
        return self._part("facet")

    @cached_property
    def renditions(self) -> DataFrame:
        """Renditions without their payloads' bytes, which are null."""
        return self._part("rendition")

    @cached_property
    def payloads(self) -> DataFrame:
        """Renditions with their payloads' bytes, read from the archives anew and not kept."""
        return records(self.archives, ("rendition",), True).where("rendition IS NOT NULL").select("archive_id", "rendition.*")
