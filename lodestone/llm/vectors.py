"""Shared parts of the vector operators: validity, sketches, buckets, exact comparison.

A *content* is a distinct (profile_id, file_id) among valid records, a *class* a distinct
vector within a profile; both are represented by their least record_id. Classes are what
is sketched and compared, so a vector that fills a third of the table costs one row.

Vectors never travel as arrays: a sketch of some 100 bytes does, and where exact values
are needed a packed form (sparse index and value pairs, or plain float32).
"""

from __future__ import annotations

import copy
import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import forest
from lodestone.session import discard, materialize

#: Columns of the random projection that all sketches are made from.
WIDTH = 1024
#: Profiles are a registry, held on the driver up to this bound.
MAX_PROFILES = 4096
#: Rows of a tile of a hot bucket: compared pair by pair, or spanned; and bytes of dense
#: float64 rows of a tile of a block.
BUCKET_TILE, SPAN_TILE, BLOCK_BYTES = 4096, 32768, 16 << 20
#: Joins of tables that grow with the data say "merge": none of them is ever broadcast.
#: Hot groups that are broadcast by key; more of them are joined by a shuffle.
MAX_HOT = 10_000


@lru_cache(maxsize=4)
def projection(dims: int, width: int = WIDTH) -> np.ndarray:
    """Fixed Gaussian projection for vectors of `dims` components, from a seed."""
    return np.random.default_rng([dims, width, 20]).standard_normal((dims, width), dtype=np.float32)


def profiles_of(profiles: DataFrame) -> dict[str, tuple[int, int]]:
    """profile_id to (number of the profile, dimensions); the registry is bounded."""
    rows = profiles.where("profile_id IS NOT NULL AND dimensions > 0").groupBy("profile_id").agg(F.max("dimensions").alias("d")).orderBy("profile_id").limit(MAX_PROFILES + 1).collect()
    if len(rows) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} profiles")
    return {r[0]: (i, int(r[1])) for i, r in enumerate(rows)}


def group_sizes(records: DataFrame, dims: dict[str, tuple[int, int]]) -> dict[int, int]:
    """Number of each profile to its count of ready records: one row a profile."""
    rows = records.where("state = 'ready' AND profile_id IS NOT NULL").groupBy("profile_id").count().where(F.col("profile_id").isin([*dims])).collect() if dims else []
    return {dims[r[0]][0]: int(r[1]) for r in rows}


#: Chance meetings a key may bring a row, whatever the number of rows.
MEETINGS = 128


def key_length(rows: int, chance: float, least: int) -> int:
    """Slots of a key so that a row meets at most MEETINGS of `rows` unrelated ones by it.

    chance: probability that one slot of unrelated rows agrees. Work per key stays in
    proportion to the rows at every size; what longer keys miss, more of them find.
    """
    return max(least, math.ceil(math.log(max(rows, 1) / MEETINGS) / -math.log(chance))) if rows > MEETINGS else least


def key_count(agree: float, slots: int, miss: float) -> int:
    """Keys of `slots` slots of which a pair, whose slots agree with probability `agree`,
    shares none with probability `miss`."""
    return math.ceil(-math.log(miss) / -math.log1p(-(agree**slots)))


def bucket_keys(group: int, slots: np.ndarray) -> np.ndarray:
    """One key per row and bucket of slots (rows, buckets, slots): the profile, exactly, and
    48 bits mixed from the bucket's number and its slots."""
    h = np.arange(1, slots.shape[1] + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(slots.shape[2]):
        # The number so far is spread over all bits before the next slot comes to it.
        h = ((h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) ^ slots[:, :, r].astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    h = h * np.uint64(0x94D049BB133111EB)
    return (np.int64(group) << np.int64(48)) | (h >> np.uint64(16)).astype(np.int64)


def dense_groups(batch: pa.RecordBatch, dims: dict[str, tuple[int, int]], check: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(profile number, row indexes, float32 matrix) of the valid rows of a batch.

    Valid: of the profile's dimensions, no null or non-finite component, and
    abs(sum of squares - 1) <= 1e-5 in double precision.
    """
    column = batch["vector"]
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    length = np.diff(offsets)
    present = column.is_valid().to_numpy(zero_copy_only=False)
    names = batch["profile_id"].to_pylist()
    want = np.array([dims.get(p, (-1, -1))[1] for p in names])
    number = np.array([dims.get(p, (-1, -1))[0] for p in names])
    for g in np.unique(number[(number >= 0) & present & (length == want)]):
        rows = np.flatnonzero((number == g) & present & (length == want))
        d = int(want[rows[0]])
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            x = flat[(offsets[part][:, None] + np.arange(d))].astype(np.float32, copy=False)
            if check:
                wide = x.astype(np.float64)
                with np.errstate(all="ignore"):
                    ok = np.isfinite(x).all(1) & (np.abs((wide * wide).sum(1) - 1) <= 1e-5)
                part, x = part[ok], x[ok]
            if len(part):
                yield int(g), part, x


def _binary(block: np.ndarray) -> pa.Array:
    """A matrix of bytes as one binary value per row."""
    n, w = block.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * w, w, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(block).tobytes())])


def _lists(block: np.ndarray) -> pa.Array:
    n, w = block.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * w, w, dtype=np.int32)), pa.array(block.ravel()))


#: A sketcher takes (profile number, matrix) and gives (codes as bytes, keys as int64).
Sketcher = Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray]]
SKETCH = "record_id long, grp int, profile_id string, file_id string, vhash binary, code binary, keys array<long>"


def sketch(records: DataFrame, dims: dict[str, tuple[int, int]], sketcher: Sketcher) -> DataFrame:
    """One row per valid record with its vector's digest, code and bucket keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, rows, x in dense_groups(batch, dims):
                code, keys = sketcher(g, x)
                take = pa.array(rows)
                digest = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x + 0.0]
                yield pa.RecordBatch.from_arrays(
                    [batch["record_id"].take(take), pa.array(np.full(len(rows), g, np.int32)), batch["profile_id"].take(take), batch["file_id"].take(take), pa.array(digest, pa.binary()), _binary(code), _lists(keys)],
                    names=["record_id", "grp", "profile_id", "file_id", "vhash", "code", "keys"],
                )

    return (
        records.where("state = 'ready' AND vector IS NOT NULL AND profile_id IS NOT NULL AND record_id IS NOT NULL")
        .select(F.col("record_id").cast("long"), "profile_id", "file_id", F.col("vector").cast("array<float>").alias("vector"))
        .mapInArrow(run, SKETCH)
    )


def contents(sketched: DataFrame) -> DataFrame:
    """(grp, id, vhash): each content with its representative's vector."""
    return sketched.where("file_id IS NOT NULL").groupBy("grp", "file_id").agg(F.min(F.struct("record_id", "vhash")).alias("r")).select("grp", F.col("r.record_id").alias("id"), F.col("r.vhash").alias("vhash"))


def classes(members: DataFrame) -> DataFrame:
    """(grp, vhash, rep): each distinct vector with its least id."""
    return members.groupBy("grp", "vhash").agg(F.min("id").alias("rep"))


def tiled(rows: DataFrame, keys: list[str], id_: str, sizes: DataFrame) -> DataFrame:
    """Rows with ti, tj, side: groups that are too big for a task cut into pairs of tiles.

    sizes: keys, tiles, one row for each group of more than one tile. A row of such a group
    goes to one tile by a hash of its id and is copied to each pair of tiles that has its
    own, so every pair of rows meets in exactly one pair of tiles (pairs within a tile meet
    in (i, i)), and no task holds more than two tiles. Groups of several tiles are rare:
    their sizes are counted first, so that without any no row is moved for them, up to
    MAX_HOT of them are broadcast, and more are joined by a shuffle.
    """
    found = sizes.limit(MAX_HOT + 1).collect()
    if not found:
        zero = F.lit(0)
        return rows.withColumns({"ti": zero, "tj": zero, "side": zero})
    if len(found) <= MAX_HOT:
        sizes = F.broadcast(rows.sparkSession.createDataFrame(found, sizes.schema))
    own = F.pmod(F.xxhash64(id_), F.coalesce("tiles", F.lit(1))).cast("int")
    out = rows.join(sizes, keys, "left").withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
    return out.withColumn("ti", F.least("side", "other")).withColumn("tj", F.greatest("side", "other")).drop("tiles", "other")


def _runs(key: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows of a sorted key matrix, and its length."""
    change = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
    return np.concatenate([[0], change, [len(key)]])


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.Table]:
    """Tables of whole groups of a stream sorted by `keys`, of `least` rows or more."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            whole = pa.Table.from_batches(held)
            key = np.stack([whole[k].to_numpy() for k in keys], 1)
            cut = int(_runs(key)[-2])
            if cut:
                yield whole.slice(0, cut)
                held = whole.slice(cut).combine_chunks().to_batches()
                rows = whole.num_rows - cut
            least = max(least, rows * 2)
    if held:
        yield pa.Table.from_batches(held)


def _fixed(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """A binary column whose values have one length, as a matrix."""
    one = column.combine_chunks()
    one = one.chunk(0) if isinstance(one, pa.ChunkedArray) else one
    offsets = np.frombuffer(one.buffers()[1], np.int32)[one.offset : one.offset + len(one) + 1]
    data = np.frombuffer(one.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.reshape(len(one), -1).view(dtype)


#: Rows from which a bucket is compared by matrix products instead of pair by pair.
LARGE = 128


class _Links:
    """Links found so far, by positions: all of them, or with `spanning` only which
    positions hang together."""

    def __init__(self, ids: np.ndarray, spanning: bool):
        self.ids, self.spanning, self.parts = ids, spanning, []
        self.label = np.arange(len(ids))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        if not self.spanning:
            self.parts.append((self.ids[i], self.ids[j]))
            return
        member, root = forest(self.label[i], self.label[j])
        if len(member):
            to = np.arange(len(self.ids))
            to[member] = root
            self.label = to[self.label]

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether a link between positions would tell anything new."""
        return self.label[i] != self.label[j] if self.spanning else np.ones(len(i), bool)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        if self.spanning:
            at = np.flatnonzero(self.label != np.arange(len(self.ids)))
            a, b = self.ids[at], self.ids[self.label[at]]
        elif self.parts:
            a, b = map(np.concatenate, zip(*self.parts))
        else:
            a = b = np.empty(0, np.int64)
        return a[a != b], b[a != b]


def in_slices(work: Callable[[np.ndarray], np.ndarray], code: np.ndarray, size: int = 4096) -> np.ndarray:
    """work(code), a slice of rows at a time: single bits take eight times the room."""
    return np.concatenate([work(code[at : at + size]) for at in range(0, max(1, len(code)), size)])


#: Takes positions i and j of pairs, gives a mask.
Wanted = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Signs:
    """Codes of sign bits are near if they differ in at most `most` bits: a number, or one
    for each profile."""

    def __init__(self, most: int | dict[int, int], words: int = WIDTH // 64):
        self.most, self.words, self.limit = most, words, most

    def prepare(self, code: np.ndarray) -> np.ndarray:
        """Codes as they came to codes as they are compared."""
        return code

    def of(self, group: np.ndarray) -> Signs:
        """This test for rows of these profiles."""
        if isinstance(self.most, int):
            return self
        out = copy.copy(self)
        known, at = np.unique(group, return_inverse=True)
        out.limit = np.array([self.most[int(g)] for g in known], np.int64)[at]
        return out

    def _limit(self, rows: np.ndarray):
        return self.limit if isinstance(self.limit, int) else self.limit[rows]

    def near(self, words: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether codes i and j, given word by word, are near.

        Pairs that differ in more of the first quarter of the bits than near ones do, by
        four deviations, are not looked at further: one near pair in 30,000 at most.
        """
        limit, first = self._limit(i), self.words // 4
        differ = np.zeros(len(i), np.uint16)
        for w in words[:first]:
            differ += np.bitwise_count(w[i] ^ w[j])
        at = np.flatnonzero(differ <= self._early(limit))
        differ, a, b = differ[at], i[at], j[at]
        for w in words[first : self.words]:
            differ += np.bitwise_count(w[a] ^ w[b])
        ok = np.zeros(len(i), bool)
        ok[at] = differ <= (limit if isinstance(limit, int) else limit[at])
        return ok

    def _early(self, limit) -> np.ndarray:
        """Bits of the first quarter that near pairs differ in at most, by four deviations."""
        share = np.asarray(limit, np.float64)
        return share / 4 + 4 * np.sqrt(share * (1 - share / (64 * self.words)) * 3 / 16)

    def blocks(self, code: np.ndarray, rows: np.ndarray, cols: np.ndarray, words: list[np.ndarray] | None = None, wanted: Wanted | None = None):
        """(i, j) of near codes, rows against columns, by matrix products of blocks of signs.

        words: the codes word by word, where they are at hand. Pairs that are not `wanted`
        may be left out.
        """
        yield from self._products(code, rows, cols, self.words, self._limit)

    def _products(self, code: np.ndarray, rows: np.ndarray, cols: np.ndarray, words: int, most: Callable):
        """(i, j) of codes that differ in at most `most` of a row's first `words` words.

        Two codes of m bits that differ in h have the product m - 2 h.
        """
        for at in range(0, len(rows), 512):
            part = rows[at : at + 512]
            left = self._plus_minus(code[part], words)
            least = np.asarray(64 * words - 2 * most(part), np.float32).reshape(-1, 1)
            for to in range(0, len(cols), 4096):
                i, j = np.nonzero(left @ self._plus_minus(code[cols[to : to + 4096]], words).T >= least)
                if len(i):
                    yield part[i], cols[to + j]

    def _plus_minus(self, code: np.ndarray, words: int) -> np.ndarray:
        return np.unpackbits(np.ascontiguousarray(code[:, :words]).view(np.uint8), axis=1).astype(np.float32) * 2 - 1


class Sets(Signs):
    """Codes of signs and of a set of signed columns (see set_code): near if the signs are
    and the exact Jaccard similarity of the sets is at least `jaccard`."""

    def __init__(self, most: int | dict[int, int], words: int, size: int, width: int, jaccard: float):
        super().__init__(most, words)
        self.size, self.width = size, width // 64
        # Sets of one size: i common elements give i / (2 size - i).
        self.common = math.ceil(2 * size * jaccard / (1 + jaccard) - 1e-9)

    def prepare(self, code: np.ndarray) -> np.ndarray:
        """Signs, which columns the set holds, and which of these are negative, as bits."""
        return in_slices(self._prepare, code)

    def _prepare(self, code: np.ndarray) -> np.ndarray:
        held = np.ascontiguousarray(code[:, self.words : self.words + self.width])
        at = np.unpackbits(held.view(np.uint8), axis=1).nonzero()[1].reshape(len(code), self.size)
        signs_ = np.unpackbits(np.ascontiguousarray(code[:, self.words + self.width :]).view(np.uint8), axis=1)[:, : self.size]
        negative = np.zeros((len(code), 64 * self.width), np.uint8)
        np.put_along_axis(negative, at, signs_, 1)
        return np.concatenate([code[:, : self.words], held, np.packbits(negative, axis=1).view(np.uint64)], 1)

    def near(self, words: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = super().near(words, i, j)
        i, j = i[ok], j[ok]
        common = np.zeros(len(i), np.uint16)
        for held, negative in zip(words[self.words : self.words + self.width], words[self.words + self.width :]):
            common += np.bitwise_count(held[i] & held[j] & ~(negative[i] ^ negative[j]))
        ok[np.flatnonzero(ok)[common < self.common]] = False
        return ok

    def blocks(self, code: np.ndarray, rows: np.ndarray, cols: np.ndarray, words: list[np.ndarray] | None = None, wanted: Wanted | None = None):
        words = words or [np.ascontiguousarray(w) for w in code.T]
        # Products of the first quarter of the signs leave few pairs to look at (see near).
        for i, j in self._products(code, rows, cols, self.words // 4, lambda part: np.floor(self._early(self._limit(part)))):
            for i, j in zip(np.array_split(i, len(i) // 65536 + 1), np.array_split(j, len(j) // 65536 + 1)):
                if wanted is not None:
                    ok = wanted(i, j)
                    i, j = i[ok], j[ok]
                ok = self.near(words, i, j)
                yield i[ok], j[ok]


def _large(code: np.ndarray, words: list[np.ndarray], rows: np.ndarray, test, kept: _Links, allowed, shared) -> None:
    """Links of the rows of a large bucket. To span it, of some of its rows the one with
    most links is taken: these hang together, and only the others are compared with all.
    Else all pairs are, less those not allowed. Of near pairs only those that are `shared`
    are links."""

    def link(these: np.ndarray, cols: np.ndarray) -> None:
        for i, j in test.blocks(code, these, cols, words, kept.apart):
            ok = kept.apart(i, j)
            i, j = i[ok], j[ok]
            ok = shared(i, j)
            kept.add(i[ok], j[ok])

    if kept.spanning:
        link(rows[np.linspace(0, len(rows) - 1, 16).astype(int)], rows)
        most = np.bincount(kept.label[rows]).argmax()
        within = kept.label[rows] == most
        rest, held = rows[~within], rows[within]
        for at in range(0, len(rest), 512):
            link(rest[at : at + 512], np.concatenate([rest[at:], held]))
        return
    for at in range(0, len(rows), 512):
        for i, j in test.blocks(code, rows[at : at + 512], rows[at:], words):
            ok = (i < j) & allowed(i, j)
            i, j = i[ok], j[ok]
            ok = shared(i, j)
            kept.add(i[ok], j[ok])


def _compare(order: np.ndarray, ends: np.ndarray, code: np.ndarray, words: list[np.ndarray], test, kept: _Links, allowed, shared) -> None:
    """Links of the groups of rows that `ends` cuts `order` into."""
    size = np.diff(ends)
    for g in np.flatnonzero(size > LARGE):
        rows = order[ends[g] : ends[g + 1]]
        if not kept.spanning or (kept.label[rows] != kept.label[rows[0]]).any():
            _large(code, words, rows, test, kept, allowed, shared)
    group = np.repeat(np.arange(len(size)), size)
    small = (size <= LARGE)[group]
    at = np.flatnonzero(small[:-1] & (group[1:] == group[:-1]))
    shift, found = 1, []
    while len(at):
        for part in np.array_split(at, len(at) // 65536 + 1):
            i, j = order[part], order[part + shift]
            ok = kept.apart(i, j) & allowed(i, j)
            i, j = i[ok], j[ok]
            near = test.near(words, i, j)
            i, j = i[near], j[near]
            ok = shared(i, j)
            found.append((i[ok], j[ok]))
        shift += 1
        at = at[: np.searchsorted(at, len(group) - shift)]
        at = at[group[at] == group[at + shift]]
        if shift & shift - 1 == 0 or not len(at):
            kept.add(*map(np.concatenate, zip(*found)))
            found = []


def bucket_pairs(rows: DataFrame, test, spanning: bool, split: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(a, b), a < b: ids in one bucket whose codes are near by `test` (Signs, Sets).

    rows: key long, id long, code binary, and perhaps fresh boolean: then pairs without a
    fresh row are not compared. Pairs are compared where they lie and only those that pass
    leave the task; with `spanning` only the edges of a spanning forest do, so a
    hot bucket gives no more edges than it has rows. Pairs found in several buckets come
    out once. `split` gives rows of codes several numbers: then only rows of a bucket that
    agree in one of them are linked, as if each were a part of a longer key, without a
    row for each such key. Sorting a bucket by each of them costs more than a matrix
    product that rules out most of its pairs, so they are looked at last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_groups(batches, ["key", "ti", "tj"], 1 << 15):
            key = np.stack([whole[k].to_numpy() for k in ("key", "ti", "tj")], 1)
            ends = _runs(key)
            if len(ends) == len(key) + 1:
                continue
            ids, code = whole["id"].to_numpy(), test.prepare(_fixed(whole["code"], np.uint64))
            kept, here = _Links(ids, spanning), test.of(key[:, 0] >> 48)
            side, cross = whole["side"].to_numpy(), key[:, 1] != key[:, 2]
            fresh = whole["fresh"].to_numpy() if "fresh" in whole.column_names else None

            def allowed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                ok = ~cross[i] | (side[i] != side[j])
                return ok if fresh is None else ok & (fresh[i] | fresh[j])

            words = [np.ascontiguousarray(w) for w in code.T]
            parts = None if split is None else split(code)

            def shared(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                return np.ones(len(i), bool) if parts is None else (parts[i] == parts[j]).any(1)

            _compare(np.arange(len(ids)), ends, code, words, here, kept, allowed, shared)
            a, b = kept.edges()
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    most = SPAN_TILE if spanning else BUCKET_TILE
    sizes = rows.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("tiles"))
    parts = tiled(rows.select("key", "id", "code", *[c for c in ("fresh",) if c in rows.columns]), ["key"], "id", sizes)
    return parts.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj").mapInArrow(run, "a long, b long").distinct()


def pack(x: np.ndarray) -> bytes:
    """Float32 values of one vector: sparse where that is shorter."""
    at = np.flatnonzero(x)
    if len(x) < 65536 and 6 * len(at) < 4 * len(x):
        return b"s" + np.uint32(len(x)).tobytes() + at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()
    return b"d" + x.astype("<f4").tobytes()


def unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"d":
        return np.frombuffer(data, "<f4", offset=1)
    out = np.zeros(int(np.frombuffer(data, "<u4", 1, 1)[0]), np.float32)
    n = (len(data) - 5) // 6
    out[np.frombuffer(data, "<u2", n, 5)] = np.frombuffer(data, "<f4", n, 5 + 2 * n)
    return out


def packed(records: DataFrame, dims: dict[str, tuple[int, int]]) -> DataFrame:
    """(id, v): packed vectors of the valid records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, x in dense_groups(batch, dims):
                yield pa.RecordBatch.from_arrays([batch["record_id"].take(pa.array(rows)), pa.array([pack(v) for v in x], pa.binary())], names=["id", "v"])

    return (
        records.where("state = 'ready' AND vector IS NOT NULL AND profile_id IS NOT NULL AND record_id IS NOT NULL")
        .select(F.col("record_id").cast("long"), "profile_id", F.col("vector").cast("array<float>").alias("vector"))
        .mapInArrow(run, "id long, v binary")
    )


def matrix(values: list[bytes]) -> np.ndarray:
    """Packed vectors as unit rows in double precision."""
    x = np.empty((len(values), len(unpack(values[0]))))
    for row, v in zip(x, values):
        row[:] = unpack(v)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


#: Vectors of a tile of a block of candidate pairs.
VERIFY_TILE = 512


def verify(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose exact cosine is at least `least`, as a table.

    pairs: distinct (a, b) of one profile, materialized. A pair's block is the least id
    among its two ends and their partners, so pairs of similar vectors share a block and a
    vector travels once for each block it is in, which is one or few, not once for each of
    its pairs. A block of more than VERIFY_TILE vectors is cut into pairs of tiles; a pair
    lies in the tiles of its ends. Only candidate pairs are scored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_groups(batches, ["block", "ti", "tj"], 256):
            ends = _runs(np.stack([whole[k].to_numpy() for k in ("block", "ti", "tj")], 1))
            out = ([np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)])
            for s, e in zip(ends[:-1], ends[1:]):
                part = whole.slice(s, e - s).combine_chunks()
                ids = part["id"].to_numpy()
                first = np.concatenate([[True], ids[1:] != ids[:-1]])
                if not first.all():  # a record that came more than once
                    part, ids = part.take(np.flatnonzero(first)), ids[first]
                others = part["others"].combine_chunks()
                others = others.chunk(0) if isinstance(others, pa.ChunkedArray) else others
                i = np.repeat(np.arange(len(ids)), np.diff(others.offsets.to_numpy()))
                to = others.flatten().to_numpy()
                j = np.searchsorted(ids, to).clip(0, len(ids) - 1)
                known = ids[j] == to
                i, j = i[known], j[known]
                x = matrix(part["v"].to_pylist())
                step = max(1, (1 << 20) // x.shape[1])
                for at in range(0, len(i), step):
                    a, b = i[at : at + step], j[at : at + step]
                    score = np.einsum("ij,ij->i", x[a], x[b]).clip(-1, 1)
                    near = score >= least
                    for column, values in zip(out, (ids[a[near]], ids[b[near]], score[near])):
                        column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["a", "b", "similarity"])

    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    label = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("label")))
    of_b = label.select(F.col("a").alias("b"), F.col("label").alias("other"))
    placed = pairs.join(label.hint("merge"), "a").join(of_b.hint("merge"), "b").select("a", "b", F.least("label", "other").alias("block"))
    placed = materialize(placed)
    held = placed.select("block", F.explode(F.array("a", "b")).alias("id")).distinct()
    sizes = held.groupBy("block").count().where(F.col("count") > VERIFY_TILE).select("block", F.ceil(F.col("count") / VERIFY_TILE).cast("int").alias("tiles"))
    found = sizes.limit(MAX_HOT + 1).collect()
    if len(found) <= MAX_HOT:
        sizes = F.broadcast(pairs.sparkSession.createDataFrame(found, sizes.schema))
    tile = [F.pmod(F.xxhash64(x), F.coalesce("tiles", F.lit(1))).cast("int") for x in ("a", "b")]
    tiles = placed.join(sizes, "block", "left") if found else placed.withColumn("tiles", F.lit(1))
    tiles = tiles.select("block", F.least(*tile).alias("ti"), F.greatest(*tile).alias("tj"), "a", "b")
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.lit(None).cast("long").alias("other"))))
    # At most a tile of partners: the list is bounded.
    needs = tiles.select("block", "ti", "tj", ends.alias("e")).groupBy("block", "ti", "tj", "e.id").agg(F.collect_list("e.other").alias("others"))
    joined = needs.join(vectors.hint("merge"), "id").repartition("block", "ti", "tj").sortWithinPartitions("block", "ti", "tj", "id")
    out = materialize(joined.mapInArrow(run, "a long, b long, similarity double"))
    discard(label, placed)
    return out


#: A block function takes (sorted ids, unit rows, side of each row, whether tiles differ).
BlockFunction = Callable[[np.ndarray, np.ndarray, np.ndarray, bool], pa.RecordBatch]


def in_blocks(blocks: DataFrame, vectors: DataFrame, work: BlockFunction, schema: str, extra: list[str] | None = None) -> DataFrame:
    """Run `work` on the exact vectors of each block; big blocks come as pairs of tiles.

    blocks: node, component, dims (with the columns named in `extra`). Every two rows of a
    block meet at least once, and within the same tile only where both tiles are one.
    """
    extra = extra or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_groups(batches, ["component", "ti", "tj"], 256):
            key = np.stack([whole[k].to_numpy() for k in ("component", "ti", "tj")], 1)
            ends = _runs(key)
            for s, e in zip(ends[:-1], ends[1:]):
                part = whole.slice(s, e - s)
                ids = part["id"].to_numpy()
                if (ids[1:] == ids[:-1]).any():  # a record that came more than once
                    part = part.take(np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])))
                if part.num_rows > 1:
                    got = work(part["id"].to_numpy(), matrix(part["v"].to_pylist()), part["side"].to_numpy(), bool(key[s, 1] != key[s, 2]), *[_fixed(part[x], np.uint64) if pa.types.is_binary(part[x].type) else part[x].to_numpy() for x in extra])
                    if got.num_rows:
                        yield got

    most = F.floor(F.lit(BLOCK_BYTES // 8) / F.first("dims"))
    sizes = blocks.groupBy("component").agg(F.count("*").alias("n"), most.alias("most"))
    hot = sizes.where("n > most").select("component", F.ceil(F.col("n") / F.col("most")).cast("int").alias("tiles"))
    rows = tiled(blocks.select(F.col("node").alias("id"), "component", *extra), ["component"], "id", hot)
    return rows.join(vectors.hint("merge"), "id").repartition("component", "ti", "tj").sortWithinPartitions("component", "ti", "tj", "id").mapInArrow(run, schema)


#: Vectors of a sample that means and rotations are learned from, at most: of one profile,
#: and of all. Below so many of a profile its mean is taken for zero.
SAMPLE, SAMPLE_OF_ALL, LEAST_SAMPLE = 512, 4096, 64


def projected_sample(records: DataFrame, dims: dict[str, tuple[int, int]]) -> dict[int, np.ndarray]:
    """Projected vectors of each profile: SAMPLE, and SAMPLE_OF_ALL over all, of its valid
    ones at most, those of least hash of record_id; 4 KB each come to the driver."""
    per_profile = max(1, min(SAMPLE, SAMPLE_OF_ALL // max(1, len(dims))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, rows, x in dense_groups(batch, dims):
                z = x @ projection(x.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(z), g, np.int32)), pa.array([v.tobytes() for v in z], pa.binary())], names=["grp", "z"])

    usable = records.where("state = 'ready' AND vector IS NOT NULL AND record_id IS NOT NULL").where(F.col("profile_id").isin([*dims]))
    order = Window.partitionBy("profile_id").orderBy(F.xxhash64("record_id"), "record_id")
    chosen = usable.select("record_id", "profile_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_profile).select("record_id")
    sample = usable.select("record_id", "profile_id", F.col("vector").cast("array<float>").alias("vector")).join(F.broadcast(chosen.limit(SAMPLE_OF_ALL)), "record_id", "left_semi")
    rows = sample.mapInArrow(run, "grp int, z binary").collect() if dims else []
    out: dict[int, list[np.ndarray]] = {}
    for g, z in rows:
        out.setdefault(g, []).append(np.frombuffer(z, np.float32))
    return {g: np.stack(z) for g, z in out.items()}


def means_of(sample: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The mean of each profile's projected vectors; none where the sample is too small."""
    return {g: z.mean(0) for g, z in sample.items() if len(z) >= LEAST_SAMPLE}


#: Squared length of a mean up to which keys are always made from centred vectors.
SHORT_MEAN = 0.2


def key_centres(sample: dict[int, np.ndarray], used: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Means that keys are centred by: those that codes are (see radii), and short ones.

    A long mean may be what a profile that is one large group has in common: without it
    the members of the group would be strangers.
    """
    return used | {g: m for g, m in means_of(sample).items() if float(m @ m) / len(m) <= SHORT_MEAN}


def centred(similarity: float, mean: np.ndarray | None) -> float:
    """The cosine that vectors of this one have, on average, once the mean is taken off.

    Unit vectors that all share a part of squared length s keep (c - s) / (1 - s) of c.
    """
    shared = 0.0 if mean is None else float(mean @ mean) / len(mean)
    return max(0.1, (similarity - shared) / (1 - min(shared, 0.9)))


def bits_for(similarity: float, width: int, spread: float = 3.0) -> int:
    """Most differing sign bits of `width` that a pair of this cosine has, by `spread` deviations."""
    p = np.arccos(similarity) / np.pi
    return int(np.ceil(width * p + spread * np.sqrt(width * p * (1 - p))))


#: Differing bits of unrelated codes, less five deviations.
FARTHEST = WIDTH // 2 - int(5 * WIDTH**0.5 / 2)


def radii(sample: dict[int, np.ndarray], groups: Iterable[int], least: float, spread: float) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """(means that codes are centred by, bits that near codes of each profile may differ in).

    Codes of centred vectors tell pairs at `least` from others better where all share a
    large part, codes of plain ones where groups share theirs. Which is to be used for a
    profile is seen on its sample: the one by which fewer pairs that are further apart look
    near. No radius goes beyond FARTHEST, within which one unrelated pair in three million
    lies: where all of a profile share half of each vector, pairs below cosine 0.62 are lost.
    """
    used, most = {}, {g: min(FARTHEST, bits_for(least, WIDTH, spread)) for g in groups}
    for g, mean in means_of(sample).items():
        z = sample[g]
        norm = np.sqrt((z * z).sum(1))
        far = np.triu((z @ z.T) / norm[:, None] / norm[None, :] < least - 0.06, 1)
        both = []
        for x, bound in ((z, most[g]), (z - mean, min(FARTHEST, bits_for(centred(least, mean), WIDTH, spread)))):
            sign = np.where(x > 0, np.float32(1), np.float32(-1))
            both.append((((WIDTH - sign @ sign.T) / 2 <= bound + 12)[far].mean() if far.any() else 0.0, bound))
        if both[1][0] < both[0][0]:
            used[g], most[g] = mean, both[1][1]
    return used, most


def signs(z: np.ndarray) -> np.ndarray:
    return np.packbits(z > 0, axis=1)
