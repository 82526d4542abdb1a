"""Streams of contents: first sightings within a watermark, appended to a reuse store.

An extension: batches have no stream of their own to match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.identity import as_bytes, content_id


def first_sightings(stream: DataFrame, text: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose content wasn't seen within the watermark; state is dropped behind it."""
    return stream.withColumn("content_id", content_id(as_bytes(F.col(text)))).withWatermark(at, delay).dropDuplicatesWithinWatermark(["content_id"])


def event_counts(stream: DataFrame, at: str, kind: str, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts of each kind in tumbling windows; late rows within the delay count."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, window), kind).agg(F.count("*").alias("n"))


def store_sink(path: str, key: str = "content_id") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: an epoch replaces only its own folder, so a retry repeats nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write
