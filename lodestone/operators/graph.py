"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import discard, materialize

EDGE = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node of its component) of the given edges; arrays of ids."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while not np.array_equal(new, hop := new[new]):
            new = hop
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(ids))
    return ids[own], ids[label[own]]


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition to star edges; at most one per node once they are folded."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch["a"].to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch["b"].to_numpy(zero_copy_only=False)])
        if len(a) > 1 << 20:
            a, b = forest(a, b)
    if len(a):
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the least id reachable; nodes with an edge only.

    edges: a long, b long, in any direction, repeated or looping as they may be; null ends
    are left out. Each round folds the edges of a partition to stars there, then joins
    large stars and small stars across partitions (every node links its larger neighbours
    to its least one, then its smaller ones), and is written to the shared folder; the
    round before is removed. It ends when a round changes nothing, however many that takes.
    A node's neighbours are never gathered: only their least is, by a partial aggregate,
    so a hub costs a row per edge and no task its whole list.
    """
    # The shuffle keeps apart the Python workers of the edges' own plan and of the folding.
    whole = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct()
    now = materialize(whole.mapInArrow(_shrink, EDGE).distinct())
    state, before = None, ()
    while state != before:
        before = state
        last, (now, state) = now, _round(now)
        discard(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())


def _round(edges: DataFrame) -> tuple[DataFrame, tuple]:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    small_least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(small_least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b")
    out = materialize(small.select("a", "b").mapInArrow(_shrink, EDGE).distinct())
    row = out.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
    return out, tuple(row)
