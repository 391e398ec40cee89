"""Incremental imports from a folder that export files arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talktree.operators.store import Store
from talktree.sources.exports import read_elements

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_elements(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (source_file, array_index, element) from JSON files as they arrive."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.json").load(folder)
    return read_elements(files.select(F.element_at(F.split("path", "/"), -1).alias("path"), "content"))


def import_stream(spark: SparkSession, folder: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Imports each micro-batch as a run of its own; the latest occurrence of a conversation wins.

    A run is stored with its batch's number, so a batch that is given again after a failure is passed over.
    """

    def run(batch: DataFrame, number: int) -> None:
        mark = f"{folder}#{checkpoint}#{number}"
        if batch.limit(1).count() and not store.table("import_runs").where(F.col("input_path") == mark).limit(1).count():
            store.import_elements(batch, input_path=mark)

    return stream_elements(spark, folder).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
