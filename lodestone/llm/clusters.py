"""Similarity clusters: MinHash candidates, exact Jaccard, components, medoids."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.near_duplicates import CHANCE, SET_SIZE, SET_WIDTH, dominant, permutations
from lodestone.llm.vectors import WIDTH, Sets, centred, key_centres, projected_sample, bucket_keys, bucket_pairs, classes, contents, group_sizes, in_blocks, in_slices, key_count, key_length, packed, profiles_of, projection, radii, sketch
from lodestone.operators.graph import components, forest
from lodestone.session import discard, lean, materialize

#: Slots that a first slot is paired with, so many bands of two slots a key.
SECONDS = 32
#: Keys of a row, at most, but for keys of one slot.
MOST_KEYS = 1 << 14
#: Mean Jaccard similarities of the sets of vectors at some cosines (simulated).
COSINES = (0.0, 0.1, 0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0)
JACCARDS = (0.025, 0.037, 0.135, 0.179, 0.208, 0.24, 0.276, 0.325, 0.384, 0.462, 0.583, 1.0)


def keys_for(rows: int, miss: float, least: float = 0.60) -> tuple[int, int]:
    """(keys, slots of a key) for a profile of `rows` rows.

    A band is a key and one of SECONDS more slots. Larger profiles take keys of more slots,
    which keeps chance meetings a key in proportion (see key_length), and so many more of
    them that a lone pair at cosine `least` is missed as rarely as by keys of one slot:
    what is found does not depend on the number of rows, the number of keys does.
    """
    slots = key_length(rows, CHANCE, 2) - 1
    agree = float(np.interp(least, COSINES, JACCARDS))
    # The second slots are the same for all keys: a pair must share one of them, and a key.
    found = (1 - miss) / (1 - (1 - agree) ** SECONDS)
    count = key_count(agree, 1, max(miss / 4, 1 - found))
    # Where centring leaves pairs little in common, long keys would be beyond number:
    # shorter ones find the same, with more chance meetings.
    while slots > 1 and lengthened(count, slots, agree) > MOST_KEYS:
        slots -= 1
    return lengthened(count, slots, agree), slots


@lru_cache(maxsize=1024)
def lengthened(count: int, slots: int, agree: float) -> int:
    """Keys of `slots` slots that miss pairs of mean similarity `agree` no more often than
    `count` keys of one slot do."""
    if slots == 1:
        return count
    least, most = count, count
    bound = missed(count, 1, agree)
    while missed(most, slots, agree) > bound:
        least, most = most, 2 * most
    while least < most:
        half = (least + most) // 2
        least, most = (half + 1, most) if missed(half, slots, agree) > bound else (least, half)
    return most


def missed(count: int, slots: int, agree: float) -> float:
    """Probability that a pair shares none of `count` keys, or no second slot.

    Sets of pairs at one cosine differ in what they have in common (about binomially), and
    long keys feel that more than short ones: the mean similarity alone tells too little.
    """
    common = np.arange(SET_SIZE + 1)
    each = 2 * agree / (1 + agree)
    weight = np.array([math.comb(SET_SIZE, i) * each**i * (1 - each) ** (SET_SIZE - i) for i in common])
    share = common / (2 * SET_SIZE - common)
    return float(1 - weight @ ((1 - (1 - share**slots) ** count) * (1 - (1 - share) ** SECONDS)))


def first_keys(sets: np.ndarray, group: int, count: int, slots: int) -> np.ndarray:
    """`count` keys of `slots` MinHash slots over the dominant sets."""
    orders = permutations(count * slots)
    # Some orders at a time: long keys are many.
    signature = np.concatenate([orders[at : at + 512, sets].min(2) for at in range(0, len(orders), 512)]).T
    return bucket_keys(group, signature.reshape(len(sets), count, slots))


def second_slots(code: np.ndarray) -> np.ndarray:
    """The SECONDS slots that all keys are paired with, from prepared codes (see Sets)."""
    return in_slices(_second_slots, code)


def _second_slots(code: np.ndarray) -> np.ndarray:
    flat = np.ascontiguousarray(code[:, WIDTH // 64 :]).view(np.uint8)
    held, negative = (np.unpackbits(x, axis=1) for x in (flat[:, : SET_WIDTH // 8], flat[:, SET_WIDTH // 8 :]))
    at = held.nonzero()[1].reshape(len(code), SET_SIZE)
    sets = 2 * at + np.take_along_axis(negative, at, 1)
    return np.stack([p[sets].min(1) for p in permutations(SECONDS, seed=24)], 1)


def set_code(z: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Signs of all columns, then which columns are in the set, then their signs in order."""
    held = np.zeros((len(z), SET_WIDTH), bool)
    np.put_along_axis(held, sets // 2, True, 1)
    negative = np.zeros((len(z), 64), bool)
    negative[:, :SET_SIZE] = np.take_along_axis(sets, np.argsort(sets // 2, axis=1), 1) % 2 == 1
    return np.concatenate([np.packbits(z >= 0, axis=1), np.packbits(held, axis=1), np.packbits(negative, axis=1)], 1)


def blocks_of(links: DataFrame, members: DataFrame, dims: dict[str, tuple[int, int]]) -> DataFrame:
    """(node, component, dims): the components of candidate links, with vector lengths."""
    spark = links.sparkSession
    sizes = spark.createDataFrame(sorted({(g, d) for g, d in dims.values()}), "grp int, dims int")
    found = components(links)
    return found.join(members.select(F.col("id").alias("node"), "grp"), "node").join(F.broadcast(sizes), "grp").select("node", "component", "dims")


def spread(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) positions: stars of the rows linked at `least` or more.

    Strips of rows are compared with all rows from them on; only links between rows that
    do not hang together yet are kept, so a block that does costs no memory for its pairs.
    """
    n = len(x)
    label = np.arange(n)
    for at in range(0, n, 512):
        hit = x[at : at + 512] @ x[at:].T >= least
        hit &= label[at : at + 512, None] != label[None, at:]
        u, v = np.nonzero(hit)
        if len(u):
            member, root = forest(label[u + at], label[v + at])
            to = np.arange(n)
            to[member] = root
            label = to[label]
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def cluster(records: DataFrame, profiles: DataFrame, least: float = 0.60, smallest: int = 3, miss: float = 0.015, jaccard: float = 0.07) -> DataFrame:
    """(cluster_id, record_id): contents of one profile linked at cosine >= `least`.

    records: as for near_pairs, with the same rules for invalid and repeated ones. A
    cluster is a connected group of at least `smallest` contents, named by its least one.

    Vectors are projected and centred by the mean of their profile (of a bounded sample, see
    key_centres), so what all of a profile share does not count. MinHash bands over the sets of dominant
    signed components give candidate pairs; the exact Jaccard similarity of these sets
    verifies them at `jaccard` (vectors at cosine 0.60 have 0.18 on average), together with
    the signs of all columns (see radii). A spanning forest of the verified pairs is kept. Its components are blocks;
    inside a block exact cosines decide, again only as a spanning forest, and connected
    components of that are the clusters. No bucket or block sends out more edges than it
    has rows.

    Bands have two slots, in profiles of more than 200,000 rows more, of which there are
    then as many more as find the same (see keys_for). All but the last are the key that
    moves a row; in its bucket the row meets those that agree in one of SECONDS second
    slots, so some 700 bands cost 22 rows. Of lone pairs (simulated, 512
    components, no common mean) 0.037 are missed at cosine 0.60, 0.012 at 0.65, 0.006 at
    0.70, 0.001 at 0.75; what no path of verified pairs joins is missed.
    """
    with lean(records.sparkSession):
        members, reps, vectors, blocks = _start(records, profiles, miss, least, jaccard)
        found = components(_links(blocks, vectors, least))
        out = materialize(_label(members, reps, found, smallest).select("cluster_id", "record_id"))
        discard(members, reps, blocks)
        return out


def _start(records, profiles, miss, least, jaccard):
    dims = profiles_of(profiles)
    by_number = {g: d for g, d in dims.values()}
    sample = projected_sample(records, dims)
    centres, most = radii(sample, by_number, least, 2.3)
    means = key_centres(sample, centres)
    shape = {g: keys_for(n, miss, centred(least, means.get(g))) for g, n in group_sizes(records, dims).items()}
    test = Sets(most, WIDTH // 64, SET_SIZE, SET_WIDTH, jaccard)

    def sketcher(group: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = x @ projection(by_number[group])
        sets = dominant(z - means.get(group, np.float32(0)))
        return set_code(z - centres.get(group, np.float32(0)), sets), first_keys(sets, group, *shape[group])

    sketched = materialize(sketch(records, dims, sketcher))
    members = materialize(contents(sketched))
    reps = materialize(classes(members))
    rows = sketched.join(reps.select(F.col("rep").alias("record_id")).hint("merge"), "record_id").select(F.explode("keys").alias("key"), F.col("record_id").alias("id"), "code")
    blocks = materialize(blocks_of(bucket_pairs(rows, test, True, second_slots), members, dims))
    discard(sketched)
    return members, reps, packed(records, dims), blocks


def _links(blocks: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    def work(ids: np.ndarray, x: np.ndarray, side: np.ndarray, cross: bool) -> pa.RecordBatch:
        member, root = spread(x, least)
        return pa.RecordBatch.from_arrays([pa.array(ids[member]), pa.array(ids[root])], names=["a", "b"])

    return in_blocks(blocks, vectors, work, "a long, b long")


def _label(members: DataFrame, reps: DataFrame, found: DataFrame, smallest: int) -> DataFrame:
    """Every content of a class under its class's component; components below size go."""
    held = members.join(reps.hint("merge"), ["grp", "vhash"]).select("rep", F.col("id").alias("record_id"))
    labelled = held.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = labelled.groupBy("component").agg(F.min("record_id").alias("cluster_id"), F.count("*").alias("size")).where(F.col("size") >= smallest)
    return labelled.join(sizes, "component").select("cluster_id", "record_id", "rep", "size")


def describe(records: DataFrame, profiles: DataFrame, least: float = 0.60, smallest: int = 3, typical: int = 3, dense: float = 0.5, miss: float = 0.015, jaccard: float = 0.07) -> DataFrame:
    """(cluster_id, part_id, size, links, medoid_id, typical_ids) per part of each cluster.

    links counts pairs of distinct vectors in the part's cluster at cosine >= `least` that
    its members have, each seen from its member. A cluster whose members have on average
    links to at least `dense` of it stays whole: its part is its cluster. A looser one is
    split around its medoids of highest degree: each member goes to the linked member of
    highest degree (ties to the smaller id), and so on up to a local peak, the medoid of
    its part. typical_ids: the members of highest degree, ties to the smaller id.
    """
    with lean(records.sparkSession):
        members, reps, vectors, blocks = _start(records, profiles, miss, least, jaccard)
        found = materialize(components(_links(blocks, vectors, least)))
        clusters = materialize(_label(members, reps, found, smallest))
        of_rep = clusters.groupBy("rep", "cluster_id", "size").agg(F.count("*").alias("copies"))
        shaped = blocks.select(F.col("node"), "dims").join(of_rep.select(F.col("rep").alias("node"), F.col("cluster_id").alias("component")), "node")

        def degrees(ids: np.ndarray, x: np.ndarray, side: np.ndarray, cross: bool) -> pa.RecordBatch:
            count = np.zeros(len(ids), np.int64)
            for at in range(0, len(ids), 512):
                hit = x[at : at + 512] @ x.T >= least
                if cross:
                    hit &= side[at : at + 512, None] != side[None, :]
                else:
                    hit[np.arange(len(hit)), np.arange(at, at + len(hit))] = False
                count[at : at + 512] = hit.sum(1)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(count)], names=["node", "degree"])

        degree = in_blocks(shaped, vectors, degrees, "node long, degree long").groupBy("node").agg(F.sum("degree").alias("degree"))
        known = materialize(of_rep.join(degree.withColumnRenamed("node", "rep"), "rep", "left").withColumn("degree", F.coalesce("degree", F.lit(0))))
        shape = known.groupBy("cluster_id").agg((F.sum("degree") >= dense * F.count("*") * (F.count("*") - 1)).alias("whole"))

        def peaks(ids: np.ndarray, x: np.ndarray, side: np.ndarray, cross: bool, degree: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((ids, -degree))
            x, own = x[order], np.arange(len(ids))
            best = own.copy()
            for at in range(0, len(ids), 512):
                best[at : at + 512] = np.minimum((x[at : at + 512] @ x.T >= least).argmax(1), own[at : at + 512])
            return pa.RecordBatch.from_arrays([pa.array(ids[order]), pa.array(ids[order][best]), pa.array(degree[order][best])], names=["node", "up", "degree"])

        loose = known.join(shape.where("NOT whole"), "cluster_id").select(F.col("rep").alias("node"), F.col("cluster_id").alias("component"), "degree")
        ups = in_blocks(loose.join(blocks.select("node", "dims"), "node"), vectors, peaks, "node long, up long, degree long", ["degree"])
        up = ups.groupBy("node").agg(F.min(F.struct((-F.col("degree")).alias("d"), "up")).alias("u")).select("node", F.col("u.up").alias("up"))
        parts = components(up.select(F.col("node").alias("a"), F.col("up").alias("b")))
        labelled = known.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").join(shape, "cluster_id")
        labelled = labelled.withColumn("part", F.when(F.col("whole"), F.col("cluster_id")).otherwise(F.coalesce("component", "rep")))
        # The most typical members are kept as a bounded list by a partial aggregate of ranks.
        ranked = labelled.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id", "part").orderBy(F.desc("degree"), "rep")))
        out = ranked.groupBy("cluster_id", "part").agg(
            F.min("rep").alias("part_id"), F.sum("copies").alias("size"), F.sum("degree").alias("links"),
            F.max(F.when(F.col("rank") == 1, F.col("rep"))).alias("medoid_id"),
            F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= typical, F.struct("rank", "rep")))), lambda s: s["rep"]).alias("typical_ids"),
        ).drop("part")
        return materialize(out)
