"""Encoding tables of text: every distinct content once, its copies by reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.identity import as_bytes, content_id
from lodestone.functions.text import outcomes


def encode_contents(rows: DataFrame, text: str, with_vector: bool = True) -> DataFrame:
    """(content_id, state[, vector], characters, error) of each distinct text.

    Contents are told apart by their digest, so the shuffle that removes copies moves one
    text per content and task and no text is encoded twice.
    """
    distinct = rows.where(F.col(text).isNotNull()).select(content_id(as_bytes(F.col(text))).alias("content_id"), F.col(text).alias("_text")).dropDuplicates(["content_id"])
    return outcomes(distinct, "content_id", "_text", with_vector)


def encode_rows(rows: DataFrame, id_: str, text: str, with_vector: bool = True) -> DataFrame:
    """(id, content_id, state, characters, error, reused[, vector]) of every row.

    Null text fails with io_error. Of the rows of a ready content the one of least id is
    encoded and the others are reused; failures are never reuse.
    """
    ids = rows.select(F.col(id_), content_id(as_bytes(F.col(text))).alias("content_id"))
    made = encode_contents(rows, text, with_vector)
    first = ids.groupBy("content_id").agg(F.min(id_).alias("_first"))
    out = ids.join(first, "content_id", "left").join(made, "content_id", "left").withColumns({"state": F.coalesce("state", F.lit("failed")), "error": F.when(F.col("content_id").isNull(), F.lit("io_error")).otherwise(F.col("error"))})
    return out.withColumn("reused", (F.col("state") == "ready") & F.coalesce(F.col(id_) != F.col("_first"), F.lit(False))).drop("_first")
