"""Sinks: accepted and rejected products and extraction failures, from a batch or from a stream."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import extraction_failures, observations
from ..operators.normalize import normalize
from ..operators.validate import split_valid, validate

TABLES = ("accepted", "rejected", "extraction_failures")


def write_outputs(extracted: DataFrame, path: str, mode: str = "append", part: str = "") -> None:
    """Write the three TABLES under path, partitioned by source, from the rows of `extract`.

    Pages are parsed and products validated once: both tables stay on the executors' disks while the writers
    read them, and what a lost executor held is computed again. part: a further folder, as "batch=7".
    """
    extracted = extracted.persist(StorageLevel.DISK_ONLY)
    validated = validate(normalize(observations(extracted))).persist(StorageLevel.DISK_ONLY)
    try:
        for name, df in zip(TABLES, (*split_valid(validated), extraction_failures(extracted))):
            df.write.mode(mode).partitionBy("source").parquet("/".join(filter(None, (path, name, part))))
    finally:
        validated.unpersist()
        extracted.unpersist()


def stream_outputs(extracted: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The same tables from a stream. A micro-batch has its own folder, which a repeated batch overwrites: no row is written twice."""
    writer = extracted.writeStream.foreachBatch(lambda rows, n: write_outputs(rows, path, "overwrite", f"batch={n}"))
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
