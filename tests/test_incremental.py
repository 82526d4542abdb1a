import random
from datetime import datetime, timedelta

import pytest

from lodestone.operators.incremental import Conflict, IncrementalTarget, replay, take_new, with_run

SCHEMA = "rev_id long, root string, path string, device long, inode long, mtime long, mtime_ns long, ctime long, ctime_ns long, file_id string, reused boolean, received_at timestamp"
RUNS = "run_no long, started_at timestamp, status string"
T0 = datetime(2025, 1, 1)


def rev(i, path, file_id, hours, inode=1, mtime=0, root="/r"):
    return (i, root, path, 1, inode, mtime, 0, 0, 0, file_id, False, T0 + timedelta(hours=hours))


def runs(*items):
    return [(n, T0 + timedelta(hours=h), s) for n, h, s in items]


ROWS = [
    rev(1, "a", "x", 1),
    rev(2, "a", "x", 2),  # the same delivery again
    rev(3, "a", "y", 3),
    rev(4, "b", None, 3),
    rev(5, "a", "y", 4, mtime=9),  # same content, another time
    rev(6, "a", "x", 30, mtime=10),
    rev(7, "c", "x", 60),  # after the last run
    rev(8, None, "x", 5),
]


def brute(rows, runs_):
    seen, last, out = set(), {}, set()
    for r in sorted(rows, key=lambda r: (r[11], r[0])):
        if r[9] is None:
            continue
        version = (r[1], r[2], *r[4:10])
        if version in seen:
            continue
        seen.add(version)
        changed = last.get((r[1], r[2])) != r[9]
        last[(r[1], r[2])] = r[9]
        run = min([(s, n) for n, s, st in runs_ if st == "succeeded" and s >= r[11]], default=None)
        if changed and run:
            out.add((run[1], r[0]))
    return out


def test_take_new_follows_the_rules(spark):
    log = runs((1, 2.5, "succeeded"), (2, 10, "failed"), (3, 24, "succeeded"), (4, 48, "succeeded"), (5, 70, "failed"))
    got = take_new(spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(log, RUNS))
    assert {(r.run_no, r.rev_id) for r in got.collect()} == brute(ROWS, log) == {(1, 1), (3, 3), (4, 6), (3, 8)}


def test_empty_and_repeated_inputs(spark):
    none = spark.createDataFrame([], SCHEMA)
    log = spark.createDataFrame(runs((1, 2, "succeeded"), (1, 2, "succeeded")), RUNS)
    assert take_new(none, log).count() == 0
    assert take_new(spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([], RUNS)).count() == 0
    twice = spark.createDataFrame(ROWS[:1] * 3, SCHEMA)
    assert [(r.run_no, r.rev_id) for r in take_new(twice, log).collect()] == [(1, 1)]


def test_runs_are_bounded():
    with pytest.raises(ValueError):
        with_run(None, [(T0, 1)] * 60_000)


def rows_of(target):
    return {(r.run_no, r.rev_id) for r in target.read().where("taken").collect()}


def test_runs_resume_after_failures_without_loss(spark, tmp_path):
    source = spark.createDataFrame(ROWS, SCHEMA)
    log = runs((1, 2.5, "succeeded"), (2, 10, "failed"), (3, 24, "succeeded"), (4, 48, "succeeded"))
    target = IncrementalTarget(spark, f"file://{tmp_path}/target")
    assert target.read() is None
    assert target.run(1, log[0][1], source) == 1
    with pytest.raises(RuntimeError):
        target.run(2, log[1][1], source, fail=RuntimeError("lost"))
    assert target.run(3, log[2][1], source) == 2
    assert target.run(3, log[2][1], source) == 0  # a retry repeats nothing
    assert target.run(4, log[3][1], source) == 1
    assert rows_of(target) == brute(ROWS, log)
    assert len(target.vacuum()) == 1
    assert rows_of(target) == brute(ROWS, log)


def test_a_run_that_another_overtook_publishes_nothing(spark, tmp_path, monkeypatch):
    source = spark.createDataFrame(ROWS, SCHEMA)
    one, two = (IncrementalTarget(spark, f"{tmp_path}/target") for _ in range(2))
    assert one.run(1, T0 + timedelta(hours=2.5), source) == 1
    monkeypatch.setattr(two, "versions", lambda: [])  # it read the log before that
    with pytest.raises(Conflict):
        two.run(3, T0 + timedelta(hours=24), source)
    monkeypatch.undo()
    assert len(one.versions()) == 1
    assert two.run(3, T0 + timedelta(hours=24), source) == 2


def test_replayed_runs_equal_one_pass(spark, tmp_path):
    rng = random.Random(4)
    rows = [rev(i, rng.choice(["a", "b", None, "c/d"]), rng.choice(["x", "y", "z", None]), rng.uniform(0, 100), rng.randrange(2), rng.randrange(3)) for i in range(200)]
    rows += rows[:20]
    log = [(n, T0 + timedelta(hours=12 * n), rng.choice(["succeeded", "succeeded", "failed", "cancelled"])) for n in range(1, 8)]
    source, runs_ = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(log, RUNS)
    got = {(r.run_no, r.rev_id) for r in replay(source, runs_, IncrementalTarget(spark, f"{tmp_path}/target")).collect()}
    assert got == brute(rows, log) == {(r.run_no, r.rev_id) for r in take_new(source, runs_).collect()}
    empty = replay(spark.createDataFrame([], SCHEMA), runs_, IncrementalTarget(spark, f"{tmp_path}/empty"))
    assert empty.count() == 0
    assert replay(source, runs_.where("false"), IncrementalTarget(spark, f"{tmp_path}/none")).count() == 0
