"""How much Python workers are handed at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Lets Arrow batches hold about ``limit`` bytes, if the session sets no bound of its own.

    Batches are bounded by rows otherwise, and rows hold whole texts.  The setting is read when a
    query runs, so it stays in the session.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(limit))
