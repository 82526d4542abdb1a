"""Deduplicating new batches against all history: a segment index over vector strings.

A vector is written as a string: its projected components are cut into blocks and each
block gives one of 32 letters, the place and sign of its largest component. Strings have a
fixed number of segments, stored by position and length; a string within the bound of edits
of another keeps some segment unchanged in place but for one pair in 500, so a batch probes
the index by its own segments, verifies the edit distance of what it meets, and appends its
segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.vectors import WIDTH, Signs, bits_for, bucket_keys, bucket_pairs, classes, packed, profiles_of, projection, signs, sketch, verify
from lodestone.operators.graph import components
from lodestone.operators.skew import salted_join
from lodestone.session import discard, lean, materialize

BLOCK, LETTERS = 16, 32
LENGTH = WIDTH // BLOCK
SEGMENTS = 20
#: Letters that two strings may differ by: 3.5 deviations more than vectors of cosine 0.95
#: do (21 of 64 on average).
EDITS = 35
#: Batches that admit_batches goes through, at most.
MAX_BATCHES = 10_000


def segments(length: int = LENGTH, count: int = SEGMENTS) -> list[tuple[int, int]]:
    """(start, length) of an even partition; shorter segments come first."""
    short, more = divmod(length, count)
    out, at = [], 0
    for i in range(count):
        n = short + (i >= count - more)
        out.append((at, n))
        at += n
    return out


def letters(z: np.ndarray) -> np.ndarray:
    """Numbers 0..31 of the letters of each row of projected components."""
    block = z.reshape(len(z), -1, BLOCK)
    at = np.abs(block).argmax(2)
    return 2 * at + (np.take_along_axis(block, at[:, :, None], 2)[:, :, 0] < 0)


def segment_keys(text: np.ndarray, group: int) -> np.ndarray:
    """A key per segment: profile, position (which fixes the length) and its letters."""
    keys = np.zeros((len(text), SEGMENTS, 1), np.int64)
    for i, (at, n) in enumerate(segments()):
        for j in range(at, at + n):
            keys[:, i, 0] = keys[:, i, 0] * LETTERS + text[:, j]
    return bucket_keys(group, keys)


#: Rows of a group of conflicts that one task solves; larger groups are solved in rounds.
MOST_TOGETHER = 1 << 20


@dataclass
class History:
    """What was accepted, in tables that each batch appends a part to.

    accepted: record_id, batch_no, file_id, cls (the node of its vector, null without one);
    index: key, id, one row for each segment; codes: id, code; vectors: id, v. Parts are
    written once and never sketched, packed or exploded again.
    """

    accepted: list[DataFrame] = field(default_factory=list)
    index: list[DataFrame] = field(default_factory=list)
    codes: list[DataFrame] = field(default_factory=list)
    vectors: list[DataFrame] = field(default_factory=list)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def admit(batch: DataFrame, profiles: DataFrame, history: History | None = None, least: float = 0.95, grow: bool = True) -> tuple[DataFrame, History | None]:
    """Decide each record of `batch` against what was accepted before and in the batch.

    batch: record_id, batch_no, file_id, profile_id, state, vector; several batch numbers
    are gone through in order of batch_no, then record_id (null batch_no first; rows with
    null record_id are left out; of repeated rows with one record_id the result has one;
    record ids are not used again by later batches). A record matches an accepted record
    with the same non-null file_id, or, if both are valid and of one profile, with cosine
    >= `least`. Returns (record_id, match_id) of those that match, match_id the least
    record_id they match, and with `grow` the history with what the batch adds.

    The history is neither sketched, packed nor compared again. Of its index only the keys
    that the batch probes go on (a semi-join on narrow rows), of its codes and vectors only
    those of nodes met, of its accepted records only those that a batch record can match.

    Segments: two strings of one segment in common are met, then signs of all components
    bound the cosine, the edit distance is verified, and exact vectors decide. A letter
    stands for its place's projection, so an insertion or deletion would make all later
    letters of unrelated projections: strings are of one length, and segments are probed in
    their own place. A pair at cosine 0.95 shares no segment with probability 0.002.

    Acceptance in order is solved exactly: records that conflict (by file, by vector or by
    link) hang together in groups, each solved in order by one task; groups of more than
    MOST_TOGETHER rows are solved in as many rounds as they need.
    """
    history = history or History()
    with lean(batch.sparkSession):
        return _admit(batch, profiles, history, least, grow)


def _admit(batch, profiles, history, least, grow):
    dims = profiles_of(profiles)
    by_number = {g: d for g, d in dims.values()}

    def sketcher(group: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = x @ projection(by_number[group])
        text = letters(z)
        return np.concatenate([signs(z), (text + 48).astype(np.uint8)], 1), segment_keys(text, group)

    sketched = materialize(sketch(batch, dims, sketcher))
    members = materialize(sketched.select("grp", "vhash", F.col("record_id").alias("id")).distinct())
    reps = materialize(classes(members))
    of_class = members.join(reps.hint("merge"), ["grp", "vhash"]).select(F.col("id").alias("record_id"), F.col("rep").alias("cls"))
    nodes_ = sketched.join(reps.select(F.col("rep").alias("record_id")).hint("merge"), "record_id").select(F.col("record_id").alias("id"), "code", "keys")
    links = _links(nodes_, packed(batch, dims), history, least)
    new = batch.where("record_id IS NOT NULL").select(F.col("record_id").cast("long"), F.col("batch_no").cast("long"), "file_id")
    records = materialize(new.join(of_class.hint("merge"), "record_id", "left").distinct())
    at = F.struct("batch_no", "record_id").alias("at")
    known = records.where("file_id IS NOT NULL OR cls IS NOT NULL").select(at, "file_id", "cls")
    held = None
    if history.accepted:
        old = _union(history.accepted)
        by_file = old.join(records.where("file_id IS NOT NULL").select("file_id").distinct().hint("merge"), "file_id", "left_semi")
        by_link = old.join(links.select(F.explode(F.array("a", "b")).alias("cls")).distinct().hint("merge"), "cls", "left_semi")
        held = materialize(by_file.unionByName(by_link).distinct().select(at, "file_id", "cls"))
    nodes = known.groupBy("file_id", "cls").agg(F.min("at").alias("at"))
    accepted = _accept(nodes, links, held)
    before = accepted if held is None else accepted.unionByName(held)
    matches = materialize(_matches(known, before, links))
    if not grow:
        discard(sketched, members, reps)
        return matches, None
    kept = records.join(matches.select("record_id").hint("merge"), "record_id", "left_anti")
    grown = materialize(kept)
    taken = grown.where("cls IS NOT NULL").select(F.col("cls").alias("id")).distinct()
    added = nodes_.join(taken.hint("merge"), "id")
    index = materialize(added.select(F.explode("keys").alias("key"), "id"))
    codes = materialize(added.select("id", "code"))
    vectors = materialize(packed(batch, dims).join(taken.hint("merge"), "id"))
    discard(sketched, members, reps)
    return matches, History([*history.accepted, grown], [*history.index, index], [*history.codes, codes], [*history.vectors, vectors])


def _links(nodes: DataFrame, vectors: DataFrame, history: History, least: float) -> DataFrame:
    """(a, b), a < b: nodes at cosine `least` or more, at least one of them of the batch."""
    fresh = nodes.select(F.explode("keys").alias("key"), "id", "code").withColumn("fresh", F.lit(True))
    text = nodes.select("id", F.substring("code", WIDTH // 8 + 1, LENGTH).cast("string").alias("text"))
    rows = fresh.withColumn("code", F.substring("code", 1, WIDTH // 8))
    if history.index:
        met = materialize(_union(history.index).join(fresh.select("key").distinct().hint("merge"), "key", "left_semi"))
        codes = materialize(_union(history.codes).join(met.select("id").distinct().hint("merge"), "id", "left_semi"))
        old = met.join(codes.hint("merge"), "id").select("key", "id", F.substring("code", 1, WIDTH // 8).alias("code"), F.lit(False).alias("fresh"))
        rows = rows.unionByName(old)
        text = text.unionByName(codes.select("id", F.substring("code", WIDTH // 8 + 1, LENGTH).cast("string").alias("text")))
        vectors = vectors.unionByName(_union(history.vectors))
    near = materialize(bucket_pairs(rows, Signs(bits_for(least, WIDTH, 3.5)), spanning=False))
    texts = near.join(text.select(F.col("id").alias("a"), F.col("text").alias("s")).hint("merge"), "a").join(text.select(F.col("id").alias("b"), F.col("text").alias("t")).hint("merge"), "b")
    close = materialize(texts.where(F.levenshtein("s", "t", EDITS) >= 0).select("a", "b"))
    out = verify(close, vectors, least)
    discard(near, close)
    return out.select("a", "b")


def _accept(nodes: DataFrame, links: DataFrame, held: DataFrame | None) -> DataFrame:
    """The accepted nodes (file_id, cls, at): greedy acceptance in order of `at`.

    Nodes that conflict with a held one are out. Of the others those without any conflict
    are accepted, and the rest is solved by groups of conflicts.
    """
    if held is not None:
        nodes = _unblocked(nodes, held, links)
    nodes = materialize(nodes.withColumn("node", F.col("at.record_id")))
    heads = [nodes.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("node").alias("head")) for c in ("file_id", "cls")]
    by_file = nodes.join(heads[0].hint("merge"), "file_id").select(F.col("node").alias("a"), F.col("head").alias("b"))
    by_class = nodes.join(heads[1].hint("merge"), "cls").select(F.col("node").alias("a"), F.col("head").alias("b"))
    ends = [heads[1].select(F.col("cls").alias(c), F.col("head").alias(f"head_{c}")) for c in ("a", "b")]
    by_link = materialize(links.join(ends[0].hint("merge"), "a").join(ends[1].hint("merge"), "b"))
    groups = materialize(components(by_file.union(by_class).union(by_link.select("head_a", "head_b"))).toDF("node", "grp"))
    grouped = nodes.join(groups.hint("merge"), "node", "left")
    alone = grouped.where("grp IS NULL").select("file_id", "cls", "at")
    tied = grouped.where("grp IS NOT NULL").select("grp", "at", "file_id", "cls", F.lit(None).cast("long").alias("other"))
    edges = by_link.join(groups.withColumnRenamed("node", "head_a").hint("merge"), "head_a").select("grp", F.lit(None).cast(tied.schema["at"].dataType).alias("at"), F.lit(None).cast("string").alias("file_id"), F.col("a").alias("cls"), F.col("b").alias("other"))
    rows = materialize(tied.union(edges))
    large = rows.groupBy("grp").count().where(F.col("count") > MOST_TOGETHER).select("grp")
    small = rows.join(large.hint("merge"), "grp", "left_anti").repartition("grp").sortWithinPartitions("grp", F.col("other").isNull(), "at")
    parts = [alone, small.mapInPandas(_solve, nodes.select("file_id", "cls", "at").schema)]
    huge = materialize(rows.where("other IS NULL").join(large.hint("merge"), "grp", "left_semi").select("file_id", "cls", "at"))
    if not huge.isEmpty():
        parts.append(_in_rounds(huge, links))
    return materialize(_union(parts))


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Accepted nodes of groups: first the links of a group come, then its nodes in order."""
    group, linked, files, taken, barred = None, {}, set(), set(), set()
    for batch in batches:
        kept = []
        for i, (grp, file_id, cls, other) in enumerate(zip(batch["grp"], batch["file_id"], batch["cls"], batch["other"])):
            if grp != group:
                group, linked, files, taken, barred = grp, {}, set(), set(), set()
            cls = None if pd.isna(cls) else int(cls)
            if not pd.isna(other):
                linked.setdefault(cls, []).append(int(other))
                linked.setdefault(int(other), []).append(cls)
            elif not (file_id is not None and file_id in files or cls is not None and (cls in taken or cls in barred)):
                kept.append(i)
                files.add(file_id)
                if cls is not None:
                    taken.add(cls)
                    barred.update(linked.get(cls, ()))
        yield batch.iloc[kept][["file_id", "cls", "at"]].astype({"cls": "Int64"})


def _in_rounds(open_: DataFrame, links: DataFrame) -> DataFrame:
    """Accepted nodes, in rounds: each takes the undecided nodes that are first in their
    file, in their class and among linked classes; what conflicts with them is decided too.
    Every round decides at least one node of each group, so it ends."""
    parts, both = [], links.select("a", "b").union(links.select("b", "a")).toDF("cls", "other")
    while not open_.isEmpty():
        in_file = open_.where("file_id IS NOT NULL").groupBy("file_id").agg(F.min("at").alias("f"))
        in_class = open_.where("cls IS NOT NULL").groupBy("cls").agg(F.min("at").alias("c"))
        linked = both.join(in_class.select(F.col("cls").alias("other"), "c"), "other").groupBy("cls").agg(F.min("c").alias("n"))
        first = open_.join(in_file, "file_id", "left").join(in_class, "cls", "left").join(linked, "cls", "left")
        parts.append(materialize(first.where("(f IS NULL OR at <= f) AND (c IS NULL OR at <= c) AND (n IS NULL OR at < n)").select("file_id", "cls", "at")))
        last, open_ = open_, materialize(_unblocked(open_, parts[-1], links))
        discard(last)
    return _union(parts)


def _unblocked(open_: DataFrame, taken: DataFrame, links: DataFrame) -> DataFrame:
    """Undecided nodes that conflict with none of the nodes just taken (themselves included)."""
    classes_ = taken.where("cls IS NOT NULL").select("cls")
    linked = [links.join(classes_.withColumnRenamed("cls", x).hint("merge"), x).select(F.col(y).alias("cls")) for x, y in (("a", "b"), ("b", "a"))]
    barred = classes_.union(linked[0]).union(linked[1]).distinct()
    out = open_.join(taken.where("file_id IS NOT NULL").select("file_id").distinct().hint("merge"), "file_id", "left_anti")
    return out.join(barred.hint("merge"), "cls", "left_anti")


def _matches(known: DataFrame, accepted: DataFrame, links: DataFrame) -> DataFrame:
    """(record_id, match_id): the least accepted record before each record that it matches."""
    one = accepted.withColumnRenamed("at", "was")
    by_file = salted_join(known.select("at", "file_id"), one.select("file_id", "was"), "file_id")
    own = one.where("cls IS NOT NULL").select("cls", "was")
    linked = [links.join(own.withColumnRenamed("cls", x).hint("merge"), x).select(F.col(y).alias("cls"), "was") for x, y in (("a", "b"), ("b", "a"))]
    by_class = salted_join(known.select("at", "cls"), own.union(linked[0]).union(linked[1]), "cls")
    both = by_file.select("at", "was").union(by_class.select("at", "was")).where("was < at")
    return both.groupBy(F.col("at.record_id").alias("record_id")).agg(F.min("was.record_id").alias("match_id"))


def admit_batches(records: DataFrame, profiles: DataFrame, least: float = 0.95) -> DataFrame:
    """(record_id, match_id): the batches of `records` admitted one by one, each against the
    history the ones before it left. batch_no is a registry of at most MAX_BATCHES values."""
    numbers = [r[0] for r in records.select("batch_no").distinct().orderBy("batch_no").limit(MAX_BATCHES + 1).collect()]
    if len(numbers) > MAX_BATCHES:
        raise ValueError(f"more than {MAX_BATCHES} batches")
    history, found = None, []
    for at, number in enumerate(numbers):
        matches, history = admit(records.where(F.col("batch_no").eqNullSafe(F.lit(number))), profiles, history, least, grow=at + 1 < len(numbers))
        found.append(matches)
    return _union(found) if found else admit(records, profiles, None, least, grow=False)[0]
