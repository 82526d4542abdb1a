"""Counters of a run, and their check against its records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_counters(records: DataFrame) -> DataFrame:
    """One row of counters. What is neither ready nor skipped failed, unsupported included."""
    state = F.col("state")
    return records.agg(
        F.count("*").alias("files_processed"),
        F.count_if(state == "ready").alias("files_ready"),
        F.count_if((state != "ready") & (state != "skipped")).alias("files_failed"),
        F.count_if(state == "skipped").alias("files_skipped"),
        F.count_if((state == "ready") & ~F.col("reused")).alias("vectors_encoded"),
        F.count_if(F.col("reused")).alias("cache_hits"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_hashed"),
    )


def recount(headers: DataFrame, all_rows: bool = False) -> DataFrame:
    """Headers whose counters contradict each other, with the rules that they break; with
    `all_rows` the others too, with an empty list of rules."""
    c = F.col
    rules = {
        "processed": c("files_processed") == c("files_ready") + c("files_failed") + c("files_skipped"),
        "encoded": c("vectors_encoded") == c("files_ready") - c("cache_hits"),
        "discovered": c("files_discovered") >= c("files_processed"),
        "total": c("files_total").isNull() | (c("files_total") == c("files_discovered")),
        "complete": ~c("complete") | (F.coalesce(c("files_total"), F.lit(-1)) == c("files_processed")),
        "cancelled": ~(c("cancelled") & c("complete")),
        "bytes": c("bytes_read") >= c("bytes_hashed"),
        "workers": c("workers").between(1, 64),
        "elapsed": (c("elapsed_seconds") >= 0) & ~F.isnan("elapsed_seconds") & (c("elapsed_seconds") < float("inf")),
    }
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    out = headers.withColumn("broken", F.array_join(broken, ","))
    return out if all_rows else out.where("broken <> ''")


def broken_record_rules() -> Column:
    """The rules of its state that a record breaks, joined by commas; empty where none.

    Of columns state, file_id, profile_id, bytes, reused, has_vector, has_digest, has_error.
    """
    c = F.col
    ready = c("state") == "ready"
    whole = c("file_id").isNotNull() & c("profile_id").isNotNull() & c("bytes").isNotNull() & c("has_vector") & c("has_digest") & ~c("has_error")
    bare = ~c("has_vector") & ~c("has_digest") & ~c("reused") & c("has_error")
    rules = {"ready": ~ready | whole, "not_ready": ready | bare, "file_id": c("file_id").isNull() | c("file_id").rlike("^sha256:[0-9a-f]{64}$")}
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]), lambda x: x.isNotNull())
    return F.array_join(broken, ",")


def exit_code(cancelled, complete, failed, skipped):
    """130 for a cancelled run, 3 for one that is incomplete or left files out, else 0."""
    return F.when(cancelled, 130).when(~complete | (failed > 0) | (skipped > 0), 3).otherwise(0)
