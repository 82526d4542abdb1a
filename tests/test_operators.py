import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import compare, counters, reuse, timeline
from lodestone.streaming.ingest import first_sightings, store_sink


def test_reuse_and_diff(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i long, c string")
    saved = spark.createDataFrame([("a", "v1"), ("a", "v0"), (None, "x")], "c string, v string")
    assert {tuple(r) for r in reuse.reuse_join(current, saved, ["c"], ["v"]).select("i", "v", "reused").collect()} == {(1, "v0", True), (2, None, False), (3, None, False)}
    assert {r.i for r in reuse.encode_set(current, saved, ["c"]).collect()} == {2, 3}
    once = reuse.encode_once(spark.createDataFrame([(2, "a"), (1, "a"), (3, None)], "i long, c string"), "c", [F.col("i")])
    assert {(r.i, r.role) for r in once.collect()} == {(1, "encoded"), (2, "reused"), (3, None)}
    before = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", "3")], "k string, c string")
    after = spark.createDataFrame([("p", "1"), ("q", "9"), ("s", "3"), ("t", "7")], "k string, c string")
    assert {tuple(r) for r in reuse.run_diff(before, after, "k", "c").collect()} == {("p", "same"), ("q", "changed"), ("r", "removed"), ("s", "moved"), ("t", "added")}


def test_conflicts_and_copies(spark):
    rows = spark.createDataFrame([("f", "p", "x", 2), ("f", "p", "y", 1), ("g", "p", "x", 3), (None, "p", "x", 4)], "f string, p string, s string, i long")
    assert [(r.f, r["values"]) for r in reuse.conflicts(rows, ["f", "p"], "s").collect()] == [("f", 2)]
    assert [tuple(r) for r in reuse.duplicate_classes(rows, "f", "i").collect()] == [("f", 2, 1)]
    assert [r.i for r in reuse.first_per_group(rows, ["p"], [F.col("i")]).collect()] == [1]


def test_counters(spark):
    empty = spark.createDataFrame([], "state string, reused boolean, bytes long")
    assert list(counters.run_counters(empty).collect()[0]) == [0] * 7


def test_pairs_and_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(compare, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 5)).astype(np.float32)
    x[10] = x[11]
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(900, [1.0, 2.0], 0), (901, [0.0] * 5, 0), (902, None, 0)]
    got = {(r.a, r.b): r.similarity for r in compare.cosine_pairs(spark.createDataFrame(rows, "i long, v array<float>, g int"), "i", "v", "g", 0.4).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = {(i, j): u[i] @ u[j] for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and u[i] @ u[j] >= 0.4}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (1, 4, 0.9)], "a long, b long, similarity double")
    assert [r.neighbour_id for r in compare.top_k(pairs, 2).where("id = 1").orderBy("rank").collect()] == [4, 2]


def shuffled(spark) -> int:
    """Rows that the session has written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_move_no_vector_once_for_each_block(spark, monkeypatch):
    """Disk in proportion to the rows: 19 blocks a group wrote every vector 19 times."""
    monkeypatch.setattr(compare, "BLOCK", 16)
    x = np.random.default_rng(3).standard_normal((600, 6)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(i, [1.0, float(i)], 7) for i in range(1000, 1005)], "i long, v array<float>, g int")
    before = shuffled(spark)
    found = compare.cosine_pairs(rows, "i", "v", "g", 0.6).collect()
    assert shuffled(spark) - before < 300
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    i, j = np.nonzero(np.triu(u @ u.T >= 0.6, 1))
    want = {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a % 2 == b % 2} | {(a, b) for a in range(1000, 1005) for b in range(a + 1, 1005)}
    assert len(found) == len(want) and {(r.a, r.b) for r in found} == want


def test_tiles_keep_every_value():
    rng = np.random.default_rng(5)
    few = (rng.integers(-3, 4, (9, 400)) / np.float32(7)).astype(np.float32)
    many = rng.standard_normal((9, 400)).astype(np.float32)
    for x in (few, many, np.where(few > 0.3, few, np.float32(-0.0)), np.concatenate([few[:1], many[:1]]), many[:, :3]):
        y = x.astype(float)
        assert np.allclose(compare._unpack(compare._pack(x), len(x)), y / np.sqrt((y * y).sum(1))[:, None], rtol=1e-13, atol=0)


def test_mean_pool(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("z", [1.0, 0.0]), ("z", [-1.0, 0.0]), ("n", None)], "g string, v array<float>")
    got = {r.g: r.vector for r in compare.pool_vectors(compare.mean_pool(rows, "g", "v"), "g").collect()}
    assert set(got) == {"a"} and np.allclose(got["a"], [2**-0.5] * 2)


def test_timeline(spark):
    rows = spark.createDataFrame([("k", 0, 1), ("k", 50, 2), ("k", 50, 3), ("k", 100, 4), ("s", 7, 9)], "k string, t long, id long")
    found = timeline.first_at_or_after(rows, timeline.midpoint_targets(rows, "k", "t", 4), "k", "t", "id")
    assert {(r.k, r.n, r.id) for r in found.collect()} == {("k", 0, 2), ("k", 1, 2), ("k", 2, 4), ("k", 3, 4), ("s", 0, 9), ("s", 1, 9), ("s", 2, 9), ("s", 3, 9)}
    assert {(r.id, r.n) for r in timeline.distinct_frames(found, "k").where("k = 'k'").collect()} == {(2, 0), (4, 2)}
    pts = spark.createDataFrame([("12",), ("N/A",), (None,)], "p string").select(timeline.parse_pts(F.col("p")).alias("v")).collect()
    assert [r.v for r in pts] == [12, None, None]
    ok = spark.range(1).select(timeline.reaches(F.lit(10), F.lit(0.999), F.lit(10)).alias("a"), timeline.reaches(F.lit(9), F.lit(0.999), F.lit(10)).alias("b")).collect()[0]
    assert (ok.a, ok.b) == (True, False)


def test_streams_keep_first_sightings(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("x", "2025-01-01 00:00:00"), ("x", "2025-01-01 00:00:05"), ("y", "2025-01-01 00:00:01")], "text string, at string").selectExpr("text", "cast(at as timestamp) at").write.parquet(str(source))
    stream = spark.readStream.schema("text string, at timestamp").parquet(str(source))
    sink = store_sink(str(tmp_path / "out"))
    run = first_sightings(stream, "text", "at").writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y"]


def test_no_profile_of_many_is_left_out(spark):
    profiles = spark.range(5000).selectExpr("concat('p', id) AS profile_id", "cast(id % 7 AS int) AS dimensions", "id AS other")
    rows = spark.range(5001).selectExpr("id", "concat('p', id) AS profile_id")
    got = {r.id: r.dimensions for r in compare.compatible(rows, profiles).collect()}
    assert got == {i: i % 7 for i in range(5000)} | {5000: None}
