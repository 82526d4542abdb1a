"""The most similar vectors of every vector: multi-index hashing with exact reranking."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.clusters import blocks_of
from lodestone.llm.vectors import (
    WIDTH, Signs, bucket_keys, bucket_pairs, classes, contents, group_sizes, in_blocks, key_centres, key_count, key_length, packed, profiles_of, projected_sample, projection, radii, signs, sketch,
)
from lodestone.session import discard, lean, materialize

#: A code is WIDTH / BLOCK letters; a letter stands for 2 * BLOCK bits of which one is set.
HALF, BLOCK = 512, 4
LENGTH = WIDTH // BLOCK
#: Share of equal letters of vectors at cosine 0.80, without learning (simulated).
AGREE_80 = 0.536
PLACES = 1_000_000


def learn(by_group: dict[int, np.ndarray], means: dict[int, np.ndarray], dims: dict[str, tuple[int, int]], steps: int = 4) -> dict[tuple[int, int], np.ndarray]:
    """The rotations of each vector length from a bounded sample, centred by `means`.

    From a random start, the rotated sample is coded and the rotation that brings it nearest
    to its codes is taken, in turns: the component that sets a block's letter comes to stand
    out, so similar vectors set the same one (at cosine 0.7 in 0.66 of the blocks of the
    test tables, where a random rotation has 0.47). All rows are indexed, whatever was sampled.
    """
    turns: dict[tuple[int, int], np.ndarray] = {}
    for d in {d for _, d in dims.values()}:
        own = [by_group[g] - means.get(g, 0) for g, w in dims.values() if w == d and g in by_group]
        for half in (0, 1):
            rng = np.random.default_rng([d, half, 22])
            turn = np.linalg.qr(rng.standard_normal((HALF, HALF)))[0].astype(np.float32)
            if own:
                z = np.concatenate(own)[:, half * HALF : (half + 1) * HALF]
                for _ in range(steps):
                    u, _, vt = np.linalg.svd(z.T @ _one_hot(z @ turn), full_matrices=False)
                    turn = (u @ vt).astype(np.float32)
            turns[d, half] = turn
    return turns


def _one_hot(y: np.ndarray) -> np.ndarray:
    """The code of rotated components: in each block the sign of the largest, else 0."""
    block = y.reshape(len(y), -1, BLOCK)
    out = np.zeros_like(block)
    at = np.abs(block).argmax(2)[:, :, None]
    np.put_along_axis(out, at, np.sign(np.take_along_axis(block, at, 2)), 2)
    return out.reshape(y.shape)


def rotated(z: np.ndarray, turns: list[np.ndarray]) -> np.ndarray:
    """Projected vectors rotated."""
    return np.concatenate([z[:, :HALF] @ turns[0], z[:, HALF:] @ turns[1]], 1)


def letters(y: np.ndarray) -> np.ndarray:
    """LENGTH numbers below 2 * BLOCK for each vector: the place and sign of the largest
    component of each block; as a binary code, the one of 2 * BLOCK bits that is set."""
    block = y.reshape(len(y), -1, BLOCK)
    at = np.abs(block).argmax(2)
    return 2 * at + (np.take_along_axis(block, at[:, :, None], 2)[:, :, 0] < 0)


@lru_cache(maxsize=16)
def substrings(count: int, size: int) -> np.ndarray:
    """Places of the letters of `count` substrings: the code split into disjoint ones in
    order, then, if there are to be more, split again in other orders."""
    out, turn = [], 0
    while len(out) < count:
        order = np.arange(LENGTH) if not turn else np.random.default_rng([turn, 23]).permutation(LENGTH)
        out += list(order[: LENGTH // size * size].reshape(-1, size))
        turn += 1
    return np.stack(out[:count])


def index_shape(rows: int, miss: float) -> tuple[int, int]:
    """(substrings, letters of one) for a profile of `rows` rows, see key_length."""
    size = key_length(rows, 1 / (2 * BLOCK), 2)
    return key_count(AGREE_80, size, miss), size


def top(scores: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, millionths) of the k best scores of each row, ties to the lower column."""
    n = scores.shape[1]
    # The k-th best score of a row bounds what can be among its k best once rounded.
    bound = np.full(len(scores), least)
    if n > k:
        np.maximum(bound, np.partition(scores, n - k, axis=1)[:, n - k], out=bound)
    row, col = np.nonzero(scores >= bound[:, None] - 2 / PLACES)
    value = np.rint(scores[row, col] * PLACES).astype(np.int64)
    order = np.lexsort((col, -value, row))
    row, col, value = row[order], col[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = (place < k) & (value >= round(least * PLACES))
    return row[kept], col[kept], value[kept]


def neighbours(records: DataFrame, profiles: DataFrame, k: int = 5, least: float = 0.60, spread: float = 2.3, miss: float = 0.01) -> DataFrame:
    """(record_id, neighbour_id, similarity): the k most similar contents of each content.

    records: as for near_pairs, with the same rules for invalid and repeated ones; only
    contents of the same profile count and only at cosine >= `least`, rounded to six
    decimals, ties to the smaller id. Contents with one vector are neighbours at 1.

    Vectors are projected, centred (see key_centres) and rotated (see learn) into
    binary codes of LENGTH letters. A code is split into substrings, each indexed; every row
    probes the index with its own. Two codes that differ in fewer letters than a split has
    substrings agree in one of them, by the pigeonhole principle; a pair at cosine 0.80
    shares none with probability `miss` at most, without learning at 0.70 with 0.07 to 0.15,
    at 0.60 with 0.2 to 0.35. What is met in a probe is retrieved if the sign codes are
    within the Hamming radius of cosine `least` (by `spread` deviations: 0.99 of the pairs at
    `least`); signs are those of the projection (see radii), since the rotation lets few
    components stand out and leaves the signs of the others to chance. What hangs together
    by retrieval is one block, where each vector travels once, and exactly the pairs within
    the radius are reranked by their floats: a block brings together all that any probe
    retrieved, hot ones in tiles.

    Substrings have so many letters that a row meets at most MEETINGS unrelated ones in each
    at any size of the table; there are as many as `miss` asks for then.
    """
    with lean(records.sparkSession):
        dims = profiles_of(profiles)
        by_number = {g: d for g, d in dims.values()}
        sample = projected_sample(records, dims)
        shape = {g: index_shape(n, miss) for g, n in group_sizes(records, dims).items()}
        centres, most = radii(sample, by_number, least, spread)
        means = key_centres(sample, centres)
        turns = learn(sample, means, dims)
        test = Signs(most)

        def sketcher(group: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            turn = [turns[by_number[group], half] for half in (0, 1)]
            z = x @ projection(by_number[group])
            y = rotated(z - means.get(group, np.float32(0)), turn)
            return signs(z - centres.get(group, np.float32(0))), bucket_keys(group, letters(y)[:, substrings(*shape[group])])

        sketched = materialize(sketch(records, dims, sketcher))
        members = materialize(contents(sketched))
        reps = materialize(classes(members))
        indexed = sketched.join(reps.select(F.col("rep").alias("record_id")).hint("merge"), "record_id")
        links = bucket_pairs(indexed.select(F.explode("keys").alias("key"), F.col("record_id").alias("id"), "code"), test, spanning=True)
        blocks = materialize(blocks_of(links, members, dims).join(sketched.select(F.col("record_id").alias("node"), "code", "grp").hint("merge"), "node"))
        discard(sketched)
        best = materialize(in_blocks(blocks, packed(records, dims), rerank(test, k, least), "a long, b long, score long", ["code", "grp"]))
        out = materialize(_expand(best, members, reps, k))
        discard(members, reps, blocks, best)
        return out


def rerank(test: Signs, k: int, least: float):
    """A block function: the k best of the pairs of each row whose codes pass `test`."""

    def work(ids: np.ndarray, x: np.ndarray, side: np.ndarray, cross: bool, code: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        out = ([np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)])
        everything = np.arange(len(ids))
        words, here = [np.ascontiguousarray(w) for w in code.T], test.of(group)
        # Rows of one tile meet those of the other, or all rows of their only tile.
        halves = [(everything[side == s], everything[side != s]) for s in np.unique(side)] if cross else [(everything, everything)]
        for rows_, cols in halves:
            step = max(1, (4 << 20) // (8 * max(1, len(cols))))
            for at in range(0, len(rows_) if len(cols) else 0, step):
                part = rows_[at : at + step]
                scores = x[part] @ x[cols].T
                if not cross:
                    scores[np.arange(len(part)), part] = -1
                hits = np.flatnonzero(scores.ravel() >= least - 1 / PLACES)
                for hit in np.array_split(hits, len(hits) // 65536 + 1):
                    i, j = np.divmod(hit, len(cols))
                    scores.ravel()[hit[~here.near(words, part[i], cols[j])]] = -1
                row, col, value = top(scores, k, least)
                for column, v in zip(out, (ids[part[row]], ids[cols[col]], value)):
                    column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["a", "b", "score"])

    return work


def _expand(best: DataFrame, members: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """Neighbours of classes to neighbours of contents: twins first, copies within k.

    A class of many contents needs only its k + 1 least as neighbours of anything.
    """
    held = members.join(reps.hint("merge"), ["grp", "vhash"]).select("rep", "id")
    least = held.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= k + 1).select("rep", F.col("id").alias("neighbour_id"))
    several = least.groupBy("rep").count().where("count > 1").select("rep")
    twins = held.join(several, "rep").select("rep", F.col("id").alias("record_id")).join(least, "rep").select("record_id", "neighbour_id", F.lit(PLACES).cast("long").alias("score"))
    order = Window.partitionBy("a").orderBy(F.desc("score"), "neighbour_id")
    of_class = best.join(least.withColumnRenamed("rep", "b"), "b").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    across = of_class.join(held.select(F.col("rep").alias("a"), F.col("id").alias("record_id")), "a").select("record_id", "neighbour_id", "score")
    own = Window.partitionBy("record_id").orderBy(F.desc("score"), "neighbour_id")
    return twins.union(across).where("record_id <> neighbour_id").withColumn("n", F.row_number().over(own)).where(F.col("n") <= k).select("record_id", "neighbour_id", (F.col("score") / PLACES).alias("similarity"))
