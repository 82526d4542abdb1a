"""Reuse of saved vectors, and encoding each content once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reuse_join(current: DataFrame, saved: DataFrame, key: list[str], take: list[str]) -> DataFrame:
    """Current rows with `take` from the saved row of the same key, and `reused`.

    saved: ready rows; of several with one key the least by `take` counts (equal keys mean
    equal contents). Null keys never match.
    """
    one = saved.groupBy(*key).agg(F.min(F.struct(*take)).alias("_saved"))
    hit = current.join(one, key, "left")
    return hit.select(*[current[c] for c in current.columns if c not in take], *[F.col(f"_saved.{c}").alias(c) for c in take], F.col("_saved").isNotNull().alias("reused"))


def encode_set(current: DataFrame, saved: DataFrame, key: list[str]) -> DataFrame:
    """Rows that no saved row serves: what has to be encoded."""
    return current.join(saved.select(*key).distinct(), key, "left_anti")


def encode_once(rows: DataFrame, content: str, order: list[Column]) -> DataFrame:
    """Rows with `role`: the first row of each content is encoded, its copies are reused.

    Rows of null content have a null role. A content that fills a third of the table is
    ranked by a partial aggregate of its first row, not gathered in a window.
    """
    first = rows.where(F.col(content).isNotNull()).groupBy(content).agg(F.min(F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)])).alias("_first"))
    own = F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)])
    return rows.join(first, content, "left").withColumn("role", F.when(F.col("_first").isNull(), None).when(own == F.col("_first"), "encoded").otherwise("reused")).drop("_first")


def run_diff(before: DataFrame, after: DataFrame, key: str, content: str, per: list[str] | None = None) -> DataFrame:
    """(*per, key, change): added, removed, changed, same, or moved (new key, known content).

    Rows are compared within equal values of `per`, which name the pair of runs.
    """
    per = per or []
    old = before.select(*per, F.col(key), F.col(content).alias("_was"))
    new = after.select(*per, F.col(key), F.col(content).alias("_is"))
    known = before.select(*per, F.col(content).alias("_is")).distinct().withColumn("_known", F.lit(True))
    both = new.join(old.withColumn("_old", F.lit(True)), [*per, key], "full").join(known, [*per, "_is"], "left")
    change = (
        F.when(F.col("_old").isNull() & F.col("_known"), "moved")
        .when(F.col("_old").isNull(), "added")
        .when(F.col("_is").isNull(), "removed")
        .when(F.col("_is") == F.col("_was"), "same")
        .otherwise("changed")
    )
    return both.select(*per, key, change.alias("change"))


def duplicate_classes(rows: DataFrame, content: str, id_: str) -> DataFrame:
    """Contents that come more than once: how often, and their least id."""
    return rows.where(F.col(content).isNotNull()).groupBy(content).agg(F.count("*").alias("copies"), F.min(id_).alias("representative")).where("copies > 1")


def conflicts(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys with more than one value, which a functional dependency forbids."""
    return rows.groupBy(*key).agg(F.countDistinct(value).alias("values")).where("values > 1")


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that aren't unique, with their count."""
    return rows.groupBy(*key).count().where("count > 1")


def first_per_group(rows: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where("_n = 1").drop("_n")
