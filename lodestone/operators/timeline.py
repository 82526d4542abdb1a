"""Sampling of timelines: midpoint targets, the first frame after each, centred windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def midpoint_targets(rows: DataFrame, key: str, at: str, count: int = 32) -> DataFrame:
    """(key, n, target): the middles of `count` equal intervals of each key's time span.

    Times are whole numbers (microseconds, ticks); targets round down.
    """
    span = rows.where(F.col(at).isNotNull()).groupBy(key).agg(F.min(at).alias("low"), F.max(at).alias("high"))
    n = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("n")
    return span.select(key, "low", "high", n).select(key, F.col("n").cast("long").alias("n"), (F.col("low") + F.floor((F.col("high") - F.col("low")) * (2 * F.col("n") + 1) / F.lit(2 * count))).alias("target"))


def first_at_or_after(rows: DataFrame, targets: DataFrame, key: str, at: str, id_: str) -> DataFrame:
    """(key, n, target, id, at): the first row at or after each target, ties to the least id.

    A forward as-of join by one window: rows and targets of a key are put in one order of
    time, and each target takes the next row below it. One shuffle by key, no pairs.
    """
    frames = rows.where(F.col(at).isNotNull()).select(F.col(key), F.col(at).alias("_t"), F.lit(1).alias("_row"), F.col(id_).alias("_id"), F.lit(None).cast("long").alias("n"))
    wanted = targets.select(F.col(key), F.col("target").alias("_t"), F.lit(0).alias("_row"), F.lit(None).cast(frames.schema["_id"].dataType).alias("_id"), "n")
    # A target sorts before the rows of its own time, so these are after it.
    ahead = Window.partitionBy(key).orderBy("_t", "_row", "_id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = frames.unionByName(wanted)
    next_ = F.first(F.when(F.col("_row") == 1, F.struct(F.col("_id").alias("id"), F.col("_t").alias("at"))), ignorenulls=True).over(ahead)
    return both.withColumn("_next", next_).where("_row = 0 AND _next IS NOT NULL").select(key, "n", F.col("_t").alias("target"), F.col("_next.id").alias("id"), F.col("_next.at").alias("at"))


def distinct_frames(found: DataFrame, key: str) -> DataFrame:
    """One row per frame that some target took, with the first such target."""
    return found.groupBy(key, "id", "at").agg(F.min("n").alias("n"))


def centred_windows(span: Column, seconds: float = 8.0, most: int = 32) -> Column:
    """array of struct(start, length) in microseconds over a span in microseconds.

    n = clamp(ceil(span / window), 1, most) equal intervals; a window lies in the middle of
    each and is at most `seconds` long; starts and lengths are whole microseconds.
    """
    width = int(seconds * 1_000_000)
    n = F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(span / F.lit(width)))).cast("int")
    interval = span / n
    length = F.least(F.lit(float(width)), interval)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.floor(F.greatest(F.lit(0.0), (i + F.lit(0.5)) * interval - length / 2)).cast("long").alias("start"), F.floor(length).cast("long").alias("length")))


def parse_pts(text: Column) -> Column:
    """Presentation time as a whole number of ticks; null for what is none, as N/A."""
    return F.when(F.trim(text).rlike(r"^-?[0-9]{1,18}$"), F.trim(text).cast("long"))


def reaches(pts: Column, target_seconds: Column, ticks_per_second: Column) -> Column:
    """Whether a frame is at or after a target, the target rounded to the nearest tick."""
    return pts >= F.round(target_seconds * ticks_per_second).cast("long")
