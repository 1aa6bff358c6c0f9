"""Incremental ingest as a stream over files (an extra of this engine: resumable, exactly once per file)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, file_format: str = "parquet") -> StreamingQuery:
    """Process the files that arrived since the last run and stop; progress lives in ``checkpoint`` (a shared folder)."""
    stream = spark.readStream.format(file_format).schema(schema).option("header", True).load(source)
    out = transform(stream) if transform else stream
    return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()


def ingest_with_rejects(spark: SparkSession, source: str, schema: str, target: str, rejects: str, checkpoint: str, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]], file_format: str = "parquet") -> StreamingQuery:
    """The same with usable and rejected rows in two tables, so that rejects are not scanned for again.

    Each batch writes to a partition named by its id and replaces it on a retry.
    """

    def both(batch: DataFrame, number: int) -> None:
        for frame, path in zip(split(batch), (target, rejects)):
            frame.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = spark.readStream.format(file_format).schema(schema).option("header", True).load(source)
    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
