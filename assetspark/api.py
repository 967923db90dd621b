"""One object for all that can be asked of a set of archives.

Lists are DataFrames; what is asked for by id comes as one row, or raises
``AssetError`` with the kind of fault.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .operators import catalog as C
from .operators import export, metadata, payloads, references, reports
from .sources import sink
from .sources.reader import Catalog


class AssetError(LookupError):
    """What was asked for is not there or cannot be given; ``code`` tells which."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


class Assets:
    """The archives under a path, or those of a DataFrame (archive_id, content)."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Assets:
        """The archives under ``path``; one that cannot be read raises ``AssetError`` when ``check`` is called."""
        return cls(Catalog.open(spark, path))

    @classmethod
    def load(cls, spark: SparkSession, content: bytes, name: str = "archive") -> Assets:
        """An archive that is held in memory."""
        return cls(Catalog(spark.createDataFrame([(name, bytes(content))], "archive_id string, content binary")))

    def check(self) -> Assets:
        """Raises the first archive's fault, if any has one; a faulty archive is not read in part."""
        bad = self.catalog.errors.orderBy("archive_id").first()
        if bad:
            raise AssetError("InvalidArchive", f"{bad.archive_id}: {bad.error}")
        return self

    def close(self) -> None:
        self.catalog.close()

    # reports
    def document_info(self) -> DataFrame:
        return metadata.document_infos(self.catalog)

    def rendition_infos(self) -> DataFrame:
        return metadata.rendition_infos(self.catalog)

    def info_json(self) -> DataFrame:
        return metadata.info_json(self.catalog)

    def diagnostics(self) -> DataFrame:
        return reports.diagnostics(self.catalog)

    def diagnostics_summary(self, samples: int = 50) -> DataFrame:
        """The totals of each archive, with its first issues as ``issue_samples``."""
        first = reports.first_issues(self.catalog, samples)
        row = F.struct("asset_id", "pos", "facet_name", "rendition_name", "issue")
        some = first.groupBy("archive_id").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x.dropFields("asset_id", "pos")).alias("issue_samples"))
        return reports.diagnostics_totals(self.catalog).join(some, "archive_id", "left")

    def with_issues(self, most: int = 20) -> DataFrame:
        return self.diagnostics().where(F.size("issues") > 0).orderBy("archive_id", "asset_id").limit(most)

    # entries and variants
    def entries(self) -> DataFrame:
        return C.variant_attributes(C.entries(self.catalog))

    def entry(self, asset_id: int, archive_id: str | None = None) -> Row:
        return self._one(self.entries(), F.col("asset_id") == asset_id, archive_id, "EntryNotFound", str(asset_id))

    def variants_for_name(self, facet_name: str) -> DataFrame:
        return self.entries().where(F.col("facet_name") == facet_name)

    def variants_for(self, asset_id: int, archive_id: str | None = None) -> DataFrame:
        own = self.entry(asset_id, archive_id)
        return self.variants_for_name(own.facet_name).where(F.col("archive_id") == own.archive_id)

    def best_variant(self, facet_name: str, query: C.VariantQuery | None = None, archive_id: str | None = None) -> Row:
        """The best variant of a facet; AssetNotFound if there is no such facet, NoMatch if no variant is as asked."""
        listed = self.variants_for_name(facet_name)
        if archive_id is not None:
            listed = listed.where(F.col("archive_id") == archive_id)
        if listed.isEmpty():
            raise AssetError("AssetNotFound", facet_name)
        found = C.best_variants(listed, query or C.VariantQuery()).orderBy("archive_id").first()
        if found is None:
            raise AssetError("NoMatch", facet_name)
        return found

    def with_key(self, key: list[int]) -> DataFrame:
        return C.with_key(self.catalog, key)

    def resolved_references(self) -> DataFrame:
        return references.resolve(self.catalog)

    # the browser's list
    def list_entries(self) -> DataFrame:
        return reports.entry_list(self.catalog)

    def list_images(self) -> DataFrame:
        return self.list_entries().where("entry_kind NOT IN ('raw-data', 'color')")

    def list_entry_summaries(self) -> DataFrame:
        return reports.summaries(self.list_entries())

    def list_image_summaries(self) -> DataFrame:
        return reports.summaries(self.list_entries(), images_only=True)

    def search(self, query: str) -> DataFrame:
        return C.search(self.list_entries(), query)

    def get_entry_info(self, entry_id: str, archive_id: str | None = None) -> Row:
        return self._one(self.list_entries(), F.col("id") == entry_id, archive_id, "EntryNotFound", entry_id)

    get_image_info = get_entry_info

    # payloads
    def get_display_payload(self, entry_id: str, archive_id: str | None = None) -> Row:
        return self._given(payloads.display_payloads, entry_id, archive_id)

    def get_download_payload(self, entry_id: str, archive_id: str | None = None) -> Row:
        return self._given(payloads.download_payloads, entry_id, archive_id)

    def get_thumbnail_payload(self, entry_id: str, most: int = 256, archive_id: str | None = None) -> Row:
        return self._given(lambda c, where: payloads.thumbnails(c, max(1, most), where), entry_id, archive_id)

    def decoded(self, limit: int | None = None) -> DataFrame:
        return payloads.decoded(self.catalog, limit)

    def pictures(self, form: str = "png", **options) -> DataFrame:
        return payloads.pictures(self.catalog, form, **options)

    def originals(self, where: Column | None = None) -> DataFrame:
        return payloads.originals(self.catalog, where)

    # writing
    def export_plan(self) -> DataFrame:
        return export.planned(self.catalog)

    def extract(self, root: str, overwrite: bool = False, strict: bool = True, folder: Column | None = None) -> DataFrame:
        """Writes the planned files and gives the summary; ``strict`` raises if any asset failed."""
        summary = sink.extract_summary(sink.extract(self.catalog, root, overwrite, folder))
        failed = summary.agg(F.sum("failed")).first()[0]
        if strict and failed:
            raise AssetError("FailedAssets", f"{failed} failed assets")
        return summary

    def write_zips(self, root: str) -> DataFrame:
        return sink.write_zips(self.catalog, root)

    def write_info(self, root: str) -> None:
        sink.write_info(self.catalog, root)

    def _one(self, rows: DataFrame, where: Column, archive_id: str | None, code: str, what: str) -> Row:
        found = rows.where(where if archive_id is None else where & (F.col("archive_id") == archive_id)).orderBy("archive_id").first()
        if found is None:
            raise AssetError(code, what)
        return found

    def _given(self, make, entry_id: str, archive_id: str | None) -> Row:
        info = self.get_entry_info(entry_id, archive_id)
        where = (F.col("id") == entry_id) & (F.col("archive_id") == info.archive_id)
        found = make(self.catalog, where).first()
        if found.error_code is not None:
            raise AssetError(found.error_code, found.error or entry_id)
        return found
