"""Near-duplicate contents by min-max hashing of their dominant signed components."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.vectors import (
    WIDTH, Signs, bits_for, bucket_keys, bucket_pairs, classes, contents, group_sizes, key_count, key_length, packed, profiles_of, projection, signs, sketch, verify,
)
from lodestone.operators.skew import salted_join
from lodestone.session import discard, lean, materialize

#: Signed components in a vector's set, of 2 x SET_WIDTH possible ones.
SET_SIZE, SET_WIDTH = 48, 512
#: Share of agreeing slots of unrelated vectors, and of vectors at cosine 0.95 (mean
#: Jaccard similarities of their sets, simulated).
CHANCE, JACCARD_95 = 0.025, 0.583


@lru_cache(maxsize=4)
def permutations(count: int, seed: int = 21) -> np.ndarray:
    rng = np.random.default_rng([count, seed])
    return np.stack([rng.permutation(2 * SET_WIDTH) for _ in range(count)]).astype(np.int32)


def dominant(z: np.ndarray) -> np.ndarray:
    """The set of a vector: its SET_SIZE largest projected components with their signs."""
    z = z[:, :SET_WIDTH]
    at = np.argpartition(-np.abs(z), SET_SIZE, axis=1)[:, :SET_SIZE]
    return 2 * at + (np.take_along_axis(z, at, 1) < 0)


def min_max(sets: np.ndarray, count: int) -> np.ndarray:
    """Signatures of 2 x count slots: minimum and maximum under each permutation."""
    placed = permutations(count)[:, sets]
    return np.concatenate([placed.min(2), placed.max(2)]).T


def band_keys(signature: np.ndarray, group: int, rows: int) -> np.ndarray:
    """One key per band of `rows` slots."""
    bands = signature.shape[1] // rows
    # Slots of a band come from different permutations: minima and maxima alternate.
    order = np.arange(bands * rows).reshape(rows, bands).T
    return bucket_keys(group, signature[:, order])


def bands_for(rows: int, jaccard: float, least: int, miss: float) -> tuple[int, int]:
    """(bands, slots of a band) for `rows` rows of a profile, see key_length and key_count."""
    slots = key_length(rows, CHANCE, least)
    return key_count(jaccard, slots, miss), slots


def near_pairs(records: DataFrame, profiles: DataFrame, least: float = 0.95, miss: float = 0.002) -> DataFrame:
    """(record_a, record_b, similarity): contents of one profile at or above `least`.

    records: record_id, file_id, profile_id, state, vector; further columns are ignored.
    Records that are not valid (see dense_groups) take no part; null ids neither. Copies
    of one content give one row, by their least record_id; different contents with one
    vector are compared once and expanded at the end. Empty tables give an empty result.

    Each vector becomes the set of its dominant signed projected components. Min-max
    hashing keeps both ends of each permutation (half as many permutations as slots);
    bands of slots are buckets, three slots or, in profiles of more than eight million
    rows, more, and so many bands that a pair at cosine 0.95 is missed with probability `miss`.
    In a bucket, pairs whose sign codes differ by no more than 3.5 deviations beyond
    `least` are candidates, and their exact cosine decides.
    """
    spark = records.sparkSession
    with lean(spark):
        dims = profiles_of(profiles)
        by_number = {g: d for g, d in dims.values()}
        shape = {g: bands_for(n, JACCARD_95, 3, miss) for g, n in group_sizes(records, dims).items()}

        def sketcher(group: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            z = x @ projection(by_number[group])
            bands, rows = shape[group]
            return signs(z), band_keys(min_max(dominant(z), -(-bands * rows // 2)), group, rows)[:, :bands]

        sketched = materialize(sketch(records, dims, sketcher))
        members = materialize(contents(sketched))
        reps = classes(members)
        buckets = sketched.join(reps.select(F.col("rep").alias("record_id")).hint("merge"), "record_id").select(F.explode("keys").alias("key"), F.col("record_id").alias("id"), "code")
        near = materialize(bucket_pairs(buckets, Signs(bits_for(least, WIDTH, 3.5)), spanning=False))
        discard(sketched)
        pairs = verify(near, packed(records, dims), least)
        discard(near)
        out = materialize(expand(pairs, members, reps))
        discard(members, pairs)
        return out


def expand(pairs: DataFrame, members: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of classes to pairs of contents, with the pairs inside each class.

    Every pair is a row of the result; a class of many contents, or one with many partners,
    is spread over tasks.
    """
    held = members.join(reps.hint("merge"), ["grp", "vhash"]).select("rep", "id")
    shared = held.groupBy("rep").count().where("count > 1").select("rep")
    twins = held.join(shared, "rep")
    inside = salted_join(twins.withColumnRenamed("id", "p"), twins.withColumnRenamed("id", "q"), "rep", 1000).where("p < q").select("p", "q", F.lit(1.0).alias("similarity"))
    first = salted_join(pairs, held.select(F.col("rep").alias("a"), F.col("id").alias("p")), "a", 10_000)
    across = salted_join(first, held.select(F.col("rep").alias("b"), F.col("id").alias("q")), "b", 10_000).select("p", "q", "similarity")
    return across.union(inside).select(F.least("p", "q").alias("record_a"), F.greatest("p", "q").alias("record_b"), "similarity")
