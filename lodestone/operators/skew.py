"""A join that spreads hot keys of its left side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """Inner join on `key`; left rows of a key with more than `most` are spread over tasks.

    Counts are partial aggregates. Only hot keys are salted: their right rows are copied
    once per part, all other rows keep part 0. Null keys match nothing and are left out
    before the shuffle. A row's part is a hash of its values, so a task that runs again
    sends the same rows.
    """
    left, right = left.where(F.col(key).isNotNull()), right.where(F.col(key).isNotNull())
    hot = left.groupBy(key).count().where(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("_parts"))
    spread = left.join(hot, key, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), "_parts").cast("int"))).drop("_parts")
    copied = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return spread.join(copied, [key, "_part"]).drop("_part")
