"""Queries over whole tables, without SQL, against brute force; what the first review found cut."""

import numpy as np

from lodestone.operators import compare
from lodestone.plans import reference
from lodestone.session import table


def test_pairs_and_neighbours_of_all_labels(spark, sf, monkeypatch):
    monkeypatch.setattr(compare, "BLOCK", 128)
    rows = table(spark, sf, "embeddings").orderBy("vec_id").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    score = np.round(x @ x.T, 6)
    got = {(r.a, r.b) for r in reference.QUERIES["q12_cosine_pairs"](spark, sf).collect()}
    i, j = np.nonzero(np.triu(score >= 0.3, 1))
    assert got == set(zip(ids[i].tolist(), ids[j].tolist()))
    np.fill_diagonal(score, -np.inf)
    best = np.argsort(-score, axis=1, kind="stable")[:, :5]
    want = {(int(ids[i]), n + 1): int(ids[j]) for i, b in enumerate(best) for n, j in enumerate(b)}
    found = reference.QUERIES["q13_top_k_neighbours"](spark, sf).collect()
    assert {(r.id, r["rank"]): r.neighbour_id for r in found} == want and len(found) == 5 * len(ids)


def test_nearest_agrees_with_ranked_pairs(spark, monkeypatch):
    monkeypatch.setattr(compare, "BLOCK", 8)
    rng = np.random.default_rng(4)
    x = rng.integers(-1, 2, (40, 3)).astype(float)  # few directions: many ties, some zero vectors
    rows = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(90, [1.0], 0), (91, None, 0)], "i long, v array<float>, g int")
    ranked = compare.top_k(compare.cosine_pairs(rows, "i", "v", "g", -1.0), 3)
    assert {tuple(r) for r in compare.nearest(rows, "i", "v", "g", 3).collect()} == {tuple(r) for r in ranked.select("id", "neighbour_id", "similarity", "rank").collect()}


def test_every_pair_of_snapshots(spark, sf):
    rows = table(spark, sf, "snapshot_record").select("snapshot_no", "root", "path", "file_id").collect()
    held = {}
    for r in rows:
        place = "/".join(x for x in (r.root, r.path) if x is not None)
        of = held.setdefault(r.snapshot_no, {})
        of[place] = max(filter(None, (of.get(place), r.file_id)), default=None)
    numbers = sorted(held)
    assert len(numbers) > 2
    want, gone = set(), set()
    for was, no in zip(numbers, numbers[1:]):
        a, b = held[was], held[no]
        known = {*a.values()} - {None}
        for place in a.keys() | b.keys():
            if place not in a:
                change = "moved" if b[place] in known else "added"
            else:
                change = "removed" if b.get(place) is None else "same" if a[place] == b[place] else "changed"
            want.add((no, place, change))
        gone |= {(no, place) for place in a.keys() - b.keys()}
    got = [(r.snapshot_no, r.place, r.change) for r in reference.QUERIES["q05_run_diff"](spark, sf).collect()]
    assert len(got) == len(want) and {*got} == want
    assert {(r.snapshot_no, r.place) for r in reference.QUERIES["q05_deleted_paths"](spark, sf).collect()} == gone


def test_registries_are_never_cut(spark, tmp_path):
    rows = spark.createDataFrame([(5000, "p5000", "text", [1.0])], "record_id long, profile_id string, family string, vector array<float>")
    many = spark.range(5001).selectExpr("concat('p', id) AS profile_id", "'n' AS name", "'text' AS family", "1L AS dimensions")
    assert [r.dimensions for r in compare.compatible(rows, many).collect()] == [1]
    rows.write.parquet(f"{tmp_path}/file_record.parquet")
    many.write.parquet(f"{tmp_path}/encoding_profile.parquet")
    assert [tuple(r) for r in reference.QUERIES["q11_vector_validate"](spark, str(tmp_path)).collect()] == [(5000, True)]
    assert [tuple(r) for r in reference.QUERIES["q23_profile_lookup"](spark, str(tmp_path)).collect()] == [(5000, "n", True)]
