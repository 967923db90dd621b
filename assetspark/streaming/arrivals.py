"""A folder of archives followed as a stream; an addition of this engine.

Parsing is a map over files, so it runs on a stream as it does on a table.
Listing an archive needs all its records, which arrive together, so each
micro-batch is opened as a catalog of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.reader import Catalog, records


def arriving(spark: SparkSession, path: str, files_at_once: int = 64) -> DataFrame:
    """(archive_id, content) of the files that arrive in a folder."""
    stream = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_at_once)
    return stream.schema("path string, modificationTime timestamp, length bigint, content binary").load(path).select(F.col("path").alias("archive_id"), "content")


def arriving_records(spark: SparkSession, path: str, parts: tuple[str, ...] = ("document", "facet", "rendition")) -> DataFrame:
    """The records of arriving archives, as ``sources.reader.records`` gives them; bad archives give their error."""
    return records(arriving(spark, path), parts)


def follow(spark: SparkSession, path: str, make: Callable[[Catalog], DataFrame], target: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Appends what ``make`` gives for the catalog of each batch of new archives to Parquet files in ``target``.

    A batch that is run again replaces its own files, so each archive counts once.
    """

    def each(batch: DataFrame, number: int) -> None:
        catalog = Catalog(batch)
        try:
            make(catalog).write.mode("overwrite").parquet(f"{target}/batch={number}")
        finally:
            catalog.close()

    writer = arriving(spark, path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
