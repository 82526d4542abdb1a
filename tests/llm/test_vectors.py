"""Vector operators against brute force on small random tables, and their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import history as history_module
from lodestone.llm import neighbours as neighbours_module
from lodestone.llm import vectors as V
from lodestone.llm.clusters import SECONDS, blocks_of, cluster, describe, keys_for, second_slots, set_code, spread
from lodestone.llm.history import LENGTH, SEGMENTS, admit, admit_batches, bucket_pairs, segments
from lodestone.llm.near_duplicates import CHANCE, JACCARD_95, SET_SIZE, SET_WIDTH, bands_for, dominant, min_max, near_pairs, permutations
from lodestone.llm.neighbours import HALF, index_shape, neighbours, rotated, top

SCHEMA = "record_id long, batch_no int, file_id string, profile_id string, state string, vector array<float>, grp string, key long, code string"
PROFILES = [("p", 64), ("q", 512)]


def unit(v):
    v = np.asarray(v, float)
    return (v / np.linalg.norm(v)).astype(np.float32)


def library(seed=0, clusters=12, members=8, dims=64, profile="p", start=1):
    """Records in clusters with near copies, exact copies, singles and dirt."""
    rng = np.random.default_rng(seed)
    out, i = [], start
    for c in range(clusters):
        centre = unit(rng.standard_normal(dims))
        for m in range(members):
            v = unit(centre + rng.standard_normal(dims) * 0.45 / np.sqrt(dims))
            out.append((i, int(rng.integers(0, 3)), f"f{i}", profile, "ready", v.tolist()))
            if m % 3 == 0:
                near = unit(v + rng.standard_normal(dims) * rng.choice([0.05, 0.2]) / np.sqrt(dims))
                out.append((i + 1, int(rng.integers(0, 3)), f"f{i + 1}", profile, "ready", near.tolist()))
                out.append((i + 2, 2, f"f{i}", profile, "ready", v.tolist()))
            i += 3
    for _ in range(10):
        out.append((i, 1, f"f{i}", profile, "ready", unit(rng.standard_normal(dims)).tolist()))
        i += 1
    some = out[0][5]
    out += [
        (i, 1, f"f{i}", profile, "ready", some),  # the same vector as another content
        (i + 1, 1, f"f{i + 1}", profile, "ready", some),
        (i + 2, 1, "f1", profile, "failed", None),
        (i + 3, 1, None, profile, "skipped", None),
        (i + 4, 1, f"f{i + 4}", profile, "ready", [0.5] * 3),
        (i + 5, 1, f"f{i + 5}", profile, "ready", (np.array(some) * 2).tolist()),
        (i + 6, 1, f"f{i + 6}", profile, "ready", [float("nan")] * dims),
        (i + 7, 1, f"f{i + 7}", "unknown", "ready", some),
        (i + 8, 1, f"f{i + 8}", None, "ready", some),
        (i + 9, 1, None, profile, "ready", some),
        (i + 10, None, "fnull", profile, "ready", unit(rng.standard_normal(dims)).tolist()),
    ]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, "x") for r in rows], SCHEMA)


def profiles(spark):
    return spark.createDataFrame(PROFILES, "profile_id string, dimensions int")


def is_valid(r):
    dims = dict(PROFILES).get(r[3])
    v = r[5]
    return r[4] == "ready" and v is not None and len(v) == dims and bool(np.isfinite(v).all()) and abs(float((np.array(v, np.float32).astype(float) ** 2).sum()) - 1) <= 1e-5


def contents(rows):
    out = {}
    for r in sorted((r for r in rows if is_valid(r) and r[2] is not None), key=lambda r: r[0]):
        out.setdefault((r[3], r[2]), (r[0], np.array(r[5], np.float32).astype(float)))
    return [(k[0], i, v / np.linalg.norm(v)) for k, (i, v) in out.items()]


def scores(rows):
    c = contents(rows)
    return {(a[1], b[1]): float(a[2] @ b[2]) for a in c for b in c if a[0] == b[0] and a[1] != b[1]}


ROWS = library() + library(1, 4, 6, 512, "q", 5000)


def test_near_pairs_find_what_brute_force_finds(spark):
    want = {(a, b) for (a, b), s in scores(ROWS).items() if a < b and s >= 0.95}
    got = near_pairs(frame(spark, ROWS), profiles(spark)).collect()
    pairs = [(r.record_a, r.record_b) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) <= want
    assert len(set(pairs)) >= 0.97 * len(want) > 20
    assert all(abs(r.similarity - scores(ROWS)[r.record_a, r.record_b]) < 1e-6 for r in got[:20])


def brute_clusters(rows):
    s = scores(rows)
    parent = {c[1]: c[1] for c in contents(rows)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), v in s.items():
        if v >= 0.6 and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for x in parent:
        groups.setdefault(find(x), set()).add(x)
    return {(c, m) for c, g in groups.items() if len(g) >= 3 for m in g}


def test_clusters_equal_brute_force(spark):
    got = [tuple(r) for r in cluster(frame(spark, ROWS), profiles(spark)).collect()]
    want = brute_clusters(ROWS)
    assert len(got) == len(set(got)) and len(set(got) ^ want) <= 0.03 * len(want)


def test_descriptions(spark):
    rows = describe(frame(spark, ROWS), profiles(spark)).collect()
    sizes = {}
    for c, _ in brute_clusters(ROWS):
        sizes[c] = sizes.get(c, 0) + 1
    total = {}
    for r in rows:
        total[r.cluster_id] = total.get(r.cluster_id, 0) + r["size"]
        assert r.medoid_id in r.typical_ids and 1 <= len(r.typical_ids) <= 3
    assert sum(total[c] == n for c, n in sizes.items()) >= 0.9 * len(sizes)


def test_loose_clusters_are_split_around_their_medoids(spark):
    # Two dense stars that one bridge links: as one cluster it is loose.
    rng = np.random.default_rng(8)
    a, b = unit(np.eye(64)[0]), unit(np.eye(64)[1])
    rows = [(i, 0, f"f{i}", "p", "ready", unit(c + 0.3 * rng.standard_normal(64) / 8).tolist()) for i, c in enumerate([a] * 6 + [b] * 6, 1)]
    rows.append((50, 0, "bridge", "p", "ready", unit(a + b).tolist()))
    got = describe(frame(spark, rows), profiles(spark), dense=0.99).collect()
    assert {r.cluster_id for r in got} == {1} and sum(r["size"] for r in got) == 13
    whole = describe(frame(spark, rows), profiles(spark), dense=0.1).collect()
    assert len(whole) == 1 and whole[0]["size"] == 13 and whole[0].medoid_id == 50


def test_neighbours_equal_brute_force(spark):
    s = scores(ROWS)
    want = set()
    for _, a, _ in contents(ROWS):
        near = sorted(((-round(v, 6), b) for (x, b), v in s.items() if x == a and round(v, 6) >= 0.6))[:5]
        want |= {(a, b) for _, b in near}
    got = {(r.record_id, r.neighbour_id) for r in neighbours(frame(spark, ROWS), profiles(spark)).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_vectors_with_a_common_mean_do_not_become_one_block(spark, monkeypatch):
    rng = np.random.default_rng(12)
    mean = unit(rng.standard_normal(512))
    rows = []
    for i in range(600):
        v = unit(mean + unit(rng.standard_normal(512)))  # cosine 0.5 on average
        rows.append((3 * i, 0, f"a{i}", "q", "ready", v.tolist()))
        if i % 3 == 0:
            rows.append((3 * i + 1, 0, f"b{i}", "q", "ready", unit(v + 0.4 * unit(rng.standard_normal(512))).tolist()))
    sizes = []

    def spy(*args):
        out = blocks_of(*args)
        sizes.extend(r[0] for r in out.groupBy("component").count().select("count").collect())
        return out

    monkeypatch.setattr(neighbours_module, "blocks_of", spy)
    got = {(r.record_id, r.neighbour_id) for r in neighbours(frame(spark, rows), profiles(spark)).collect()}
    want = {(a, b) for i in range(0, 600, 3) for a, b in ((3 * i, 3 * i + 1), (3 * i + 1, 3 * i))}
    assert len(want - got) <= 0.01 * len(want) and max(sizes) < 30


def test_unrelated_rows_meet_by_chance_in_proportion_to_their_number():
    # Work per row stays bounded: meetings by all keys of a row, at any number of rows.
    for n in (1000, 100_000, 10_000_000, 1_000_000_000):
        count, size = index_shape(n, 0.01)
        assert n * (1 / 8) ** size <= V.MEETINGS or size == 2
        keys, slots = keys_for(n, 0.015)
        assert n * CHANCE ** (slots + 1) <= V.MEETINGS or slots == 1
        bands, rows = bands_for(n, JACCARD_95, 3, 0.012)
        assert n * CHANCE**rows <= V.MEETINGS or rows == 3
    # What passes the test of codes is far below one in a million of unrelated pairs.
    rng = np.random.default_rng(13)
    x = rng.standard_normal((3000, 512)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = np.linalg.qr(rng.standard_normal((HALF, HALF)))[0].astype(np.float32)
    code = np.ascontiguousarray(V.signs(rotated(x @ V.projection(512), [turn, turn]))).view(np.uint64)
    i, j = map(np.concatenate, zip(*V.Signs(V.bits_for(0.53, V.WIDTH, 2.3)).blocks(code, np.arange(3000), np.arange(3000))))
    assert ((i == j) == (np.arange(len(i)) >= 0)).sum() == len(i) == 3000


def test_keys_tell_apart_profiles_buckets_and_slots():
    for slots in (1, 2):
        grid = np.stack(np.meshgrid(*[np.arange(200 if slots == 1 else 40)] * slots), -1).reshape(-1, 1, slots).repeat(64, 1)
        keys = [V.bucket_keys(g, grid) for g in (0, 1, 4095)]
        assert len(np.unique(np.concatenate(keys))) == 3 * grid.shape[0] * 64
        assert all((k >> 48 == g).all() for k, g in zip(keys, (0, 1, 4095)))


def test_equal_codes_are_near_by_every_test():
    rng = np.random.default_rng(14)
    z = rng.standard_normal((40, V.WIDTH)).astype(np.float32)
    sets = dominant(z)
    for test, code in ((V.Signs(100), V.signs(z)), (V.Signs({7: 100}), V.signs(z)), (V.Sets(100, 16, SET_SIZE, SET_WIDTH, 0.9), set_code(z, sets))):
        code = test.prepare(np.ascontiguousarray(code).view(np.uint64))
        test = test.of(np.full(40, 7))
        words = [np.ascontiguousarray(w) for w in code.T]
        i, j = map(np.concatenate, zip(*test.blocks(code, np.arange(40), np.arange(40))))
        assert (i == j).all() and sorted(i) == list(range(40)) and test.near(words, np.arange(40), np.arange(40)).all()
    assert np.array_equal(second_slots(code), np.stack([p[sets].min(1) for p in permutations(SECONDS, seed=24)], 1))


def test_sets_are_compared_exactly():
    rng = np.random.default_rng(15)
    z = rng.standard_normal((60, V.WIDTH)).astype(np.float32)
    z[1::2] = 0.8 * z[::2] + 0.6 * z[1::2]
    sets = dominant(z)
    test = V.Sets(V.WIDTH, 16, SET_SIZE, SET_WIDTH, 0.2)
    code = test.prepare(np.ascontiguousarray(set_code(-z, sets)).view(np.uint64))
    i, j = np.triu_indices(60, 1)
    share = np.array([len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) for a, b in zip(i, j)])
    assert np.array_equal(test.near([np.ascontiguousarray(w) for w in code.T], i, j), share >= 0.2) and 10 < (share >= 0.2).sum() < 60


def test_ties_go_to_the_smaller_id():
    row, col, value = top(np.array([[-1.0, 0.9, 0.9000000001, 0.7, 0.9]]), 2, 0.6)
    assert sorted(zip(row, col, value)) == [(0, 1, 900000), (0, 2, 900000)]


def brute_admit(rows):
    accepted, out = [], {}
    for r in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[0])):
        v = np.array(r[5], np.float32).astype(float) if is_valid(r) else None
        match = [i for i, f, p, w in accepted if (f is not None and f == r[2]) or (v is not None and w is not None and p == r[3] and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95)]
        if match:
            out[r[0]] = min(match)
        else:
            accepted.append((r[0], r[2], r[3], v))
    return out


def test_admission_equals_brute_force_at_once_and_by_batches(spark):
    want = brute_admit(ROWS)
    once = {r.record_id: r.match_id for r in admit(frame(spark, ROWS), profiles(spark))[0].collect()}
    assert len(want) > 40 and sum(once.get(k) == v for k, v in want.items()) >= 0.97 * len(want) and len(once.keys() - want.keys()) <= 2
    history, steps = None, {}
    for batch in (None, 0, 1, 2):
        part = [r for r in ROWS if r[1] == batch]
        found, history = admit(frame(spark, part), profiles(spark), history)
        steps |= {r.record_id: r.match_id for r in found.collect()}
    assert steps == once
    assert sum(t.count() for t in history.accepted) == len(ROWS) - len(once)
    by_batch = admit_batches(frame(spark, ROWS), profiles(spark))
    assert {r.record_id: r.match_id for r in by_batch.collect()} == once


def chain(length, start=1):
    """Contents each near the last one and only that: steps of 0.196 along edges of a cube."""
    rows = []
    for t in range(length):
        axis, turn = divmod(t, 8)
        v = np.zeros(512)
        v[axis], v[axis + 1] = np.cos(turn * np.pi / 16), np.sin(turn * np.pi / 16)
        rows.append((start + t, 0, f"f{t}", "q", "ready", unit(v).tolist()))
    return rows


@pytest.mark.parametrize("length,together", [(1000, 1 << 20), (30, 8)])
def test_chains_of_near_contents_are_solved_whatever_their_length(spark, monkeypatch, length, together):
    rows = chain(length)
    monkeypatch.setattr(history_module, "MOST_TOGETHER", together)
    got = {r.record_id: r.match_id for r in admit(frame(spark, rows), profiles(spark), grow=False)[0].collect()}
    assert got == brute_admit(rows) and len(got) == length // 2


def test_a_batch_reads_no_more_of_the_history_than_it_meets(spark, monkeypatch):
    seen = []

    def spy(rows, *args, **kwargs):
        seen.append((rows.where("fresh").count(), rows.where("NOT fresh").count()))
        return bucket_pairs(rows, *args, **kwargs)

    monkeypatch.setattr(history_module, "bucket_pairs", spy)
    history = None
    for batch in range(4):  # the same small batch, moved far from all earlier ones
        part = [(*r[:2], f"b{batch}-{r[2]}", *r[3:]) for r in library(50 + batch, 3, 4, 512, "q", 1000 * batch + 1) if r[5] is not None and len(r[5]) == 512]
        history = admit(frame(spark, part), profiles(spark), history)[1]
    assert all(old <= 0.05 * fresh for fresh, old in seen) and sum(t.count() for t in history.index) > 3 * seen[0][0]


def test_a_failed_copy_of_a_rejected_content_is_accepted(spark):
    v = unit(np.arange(64) + 1.0).tolist()
    rows = [(1, 0, "a", "p", "ready", v), (2, 0, "b", "p", "ready", v), (3, 0, "b", "p", "failed", None), (4, 0, "b", "p", "ready", v)]
    got = {r.record_id: r.match_id for r in admit(frame(spark, rows), profiles(spark))[0].collect()}
    assert got == brute_admit(rows) == {2: 1, 4: 1}


@pytest.mark.parametrize("rows", [[], [(1, 0, None, None, None, None)], library()[:1]])
def test_empty_and_lone_tables(spark, rows):
    f, p = frame(spark, rows), profiles(spark)
    assert near_pairs(f, p).count() == cluster(f, p).count() == neighbours(f, p).count() == admit(f, p)[0].count() == 0
    none = p.where("false")
    assert near_pairs(f, none).count() == neighbours(f, none).count() == 0


def test_repeated_rows_change_nothing(spark):
    rows = ROWS[:40]
    once, twice = frame(spark, rows), frame(spark, rows + rows)
    for f in (lambda t: near_pairs(t, profiles(spark)).select("record_a", "record_b"), lambda t: cluster(t, profiles(spark)), lambda t: neighbours(t, profiles(spark)).select("record_id", "neighbour_id"), lambda t: admit(t, profiles(spark))[0]):
        assert sorted(map(tuple, f(once).collect())) == sorted(map(tuple, f(twice).collect()))


def test_hot_groups_are_cut_into_tiles_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = unit(rng.standard_normal(64))
    rows = [(i, 0, f"f{i}", "p", "ready", unit(centre + rng.standard_normal(64) * 0.3 / 8).tolist()) for i in range(1, 150)]
    f, p = frame(spark, rows), profiles(spark)
    want = [sorted(map(tuple, x.collect())) for x in (near_pairs(f, p).select("record_a", "record_b"), cluster(f, p), neighbours(f, p))]
    monkeypatch.setattr(V, "BUCKET_TILE", 16)
    monkeypatch.setattr(V, "SPAN_TILE", 16)
    monkeypatch.setattr(V, "LARGE", 8)
    monkeypatch.setattr(V, "BLOCK_BYTES", 64 * 8 * 20)
    assert want == [sorted(map(tuple, x.collect())) for x in (near_pairs(f, p).select("record_a", "record_b"), cluster(f, p), neighbours(f, p))]
    assert len(want[1]) == 149


def test_tiles_bring_every_pair_together_once(spark):
    rows = spark.range(40).select(F.lit(1).alias("key"), "id")
    sizes = spark.createDataFrame([(1, 3)], "key int, tiles int")
    seen = {}
    for r in V.tiled(rows, ["key"], "id", sizes).collect():
        seen.setdefault((r.ti, r.tj), []).append((r.id, r.side))
    met = [tuple(sorted((a, b))) for (i, j), g in seen.items() for k, (a, s) in enumerate(g) for b, t in g[k + 1 :] if i == j or s != t]
    assert len(met) == len(set(met)) == 40 * 39 // 2


def test_packed_vectors_round_trip():
    rng = np.random.default_rng(4)
    for v in (rng.standard_normal(512).astype(np.float32), np.where(rng.random(4096) < 0.05, 1, 0).astype(np.float32), np.zeros(8, np.float32)):
        assert np.array_equal(V.unpack(V.pack(v)), v)


def test_spread_finds_components():
    x = np.eye(6)[[0, 0, 1, 2, 2, 3]]
    member, root = spread(x, 0.5)
    assert dict(zip(member.tolist(), root.tolist())) == {1: 0, 4: 3}


def test_segments_cover_the_string():
    parts = segments()
    assert len(parts) == SEGMENTS and [a for a, _ in parts] == list(np.cumsum([0] + [n for _, n in parts[:-1]])) and sum(n for _, n in parts) == LENGTH


def test_minima_and_maxima_agree_as_often_as_sets_do():
    rng = np.random.default_rng(5)
    a = np.stack([rng.choice(1024, 48, replace=False) for _ in range(200)])
    b = a.copy()
    for row in b:
        row[:16] = rng.choice(np.setdiff1d(np.arange(1024), row), 16, replace=False)
    share = (min_max(a, 60) == min_max(b, 60)).mean()
    assert abs(share - 32 / 64) < 0.03


def test_lone_pairs_near_the_least_cosine_cluster(spark):
    rng, rows, dims, cosine = np.random.default_rng(3), [], 512, 0.63
    for i in range(200):
        a = unit(rng.standard_normal(dims))
        b = rng.standard_normal(dims)
        b = unit(cosine * a + np.sqrt(1 - cosine**2) * unit(b - (a @ b) * a))
        rows += [(2 * i, 0, f"f{2 * i}", "q", "ready", a.tolist()), (2 * i + 1, 0, f"f{2 * i + 1}", "q", "ready", b.tolist())]
    found = cluster(frame(spark, rows), profiles(spark), smallest=2)
    assert found.count() >= 0.93 * len(rows)  # 28 bands of 2 find about 0.65


@pytest.mark.parametrize("rows", [205_000, 10_000_000, 1_000_000_000])
def test_lone_pairs_are_missed_as_rarely_at_any_number_of_rows(rows):
    rng = np.random.default_rng(16)
    a, b = rng.standard_normal((2, 2000, 512))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.6 * a + 0.8 * b / np.linalg.norm(b, axis=1, keepdims=True)
    held = np.zeros((2, 2000, 2 * SET_WIDTH), bool)
    for side, x in zip(held, (a, b)):
        np.put_along_axis(side, dominant(x.astype(np.float32) @ V.projection(512)), True, 1)
    common = (held[0] & held[1]).sum(1)
    share = common / (2 * SET_SIZE - common)

    def miss(n):
        keys, slots = keys_for(n, 0.015)
        return 1 - ((1 - (1 - share**slots) ** keys) * (1 - (1 - share) ** SECONDS)).mean()

    assert miss(rows) <= 1.1 * miss(1000) < 0.04 and keys_for(rows, 0.015)[1] > 1
    # With little in common, shorter keys keep their number bounded.
    assert 1 < keys_for(rows, 0.015, 0.2)[0] <= 1 << 14


def test_long_keys_cluster_lone_pairs_too(spark, monkeypatch):
    monkeypatch.setattr(V, "MEETINGS", 0.2)  # a small table is keyed as one of 205,000 rows and more is
    assert keys_for(400, 0.015)[1] == 2
    test_lone_pairs_near_the_least_cosine_cluster(spark)


def test_large_buckets_look_at_few_of_their_pairs(spark):
    rng, n = np.random.default_rng(17), 1200
    z = rng.standard_normal((n, V.WIDTH)).astype(np.float32)
    z[1:200:2] = 0.75 * z[0:200:2] + 0.66 * z[1:200:2]
    sets = dominant(z)
    code = set_code(z, sets)
    seen = spark.sparkContext.accumulator(0)

    class Counted(V.Sets):
        def near(self, words, i, j):
            seen.add(len(i))
            return super().near(words, i, j)

    test = Counted({0: 336}, 16, SET_SIZE, SET_WIDTH, 0.07)
    got = V.bucket_pairs(spark.createDataFrame([(5, i, c.tobytes()) for i, c in enumerate(code)], "key long, id long, code binary"), test, True, second_slots)
    got = sorted(map(tuple, got.collect()))
    looked = seen.value
    whole = V.Sets(336, 16, SET_SIZE, SET_WIDTH, 0.07)
    prepared = whole.prepare(np.ascontiguousarray(code).view(np.uint64))
    i, j = np.triu_indices(n, 1)
    slots = second_slots(prepared)
    ok = whole.near([np.ascontiguousarray(w) for w in prepared.T], i, j) & (slots[i] == slots[j]).any(1)
    assert got == list(zip(i[ok].tolist(), j[ok].tolist())) and len(got) >= 95
    assert looked <= 0.05 * len(i)
