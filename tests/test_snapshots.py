import random
from datetime import datetime, timedelta

import pytest

from lodestone.operators import snapshots
from lodestone.operators.snapshots import snapshot_changes

LIST = "root string, snapshot_no int, path string, file_id string, state string, bytes long, change string, delivered_at timestamp"
HEAD = "root string, snapshot_no int, complete boolean"
T0 = datetime(2025, 1, 1)


def brute(rows, heads):
    done = {}
    for root, no, ok in heads:
        if ok and root is not None:
            done.setdefault(root, set()).add(no)
    latest = {}
    for root, no, path, file_id, state, _, _, at in rows:
        if path is not None and (latest.get((root, no, path), (datetime.min,))[0] < at):
            latest[(root, no, path)] = (at, file_id, state)
    out = set()
    for root, nos in done.items():
        nos = sorted(nos)
        for before, after in zip(nos, nos[1:]):
            a = {p: v[1:] for (r, n, p), v in latest.items() if (r, n) == (root, before)}
            b = {p: v[1:] for (r, n, p), v in latest.items() if (r, n) == (root, after)}
            out |= {(root, after, p, "added") for p in b.keys() - a.keys()} | {(root, after, p, "removed") for p in a.keys() - b.keys()}
            out |= {(root, after, p, "changed") for p in a.keys() & b.keys() if a[p] != b[p]}
    return out


def got(spark, rows, heads):
    return {tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, LIST), spark.createDataFrame(heads, HEAD)).collect()}


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(snapshots, "MAX_BROADCAST", broadcast)
    rng = random.Random(1)
    rows = []
    for root in ("a", "b"):
        for no in range(1, 7):
            for p in range(6):
                for k in range(rng.choice([0, 1, 1, 2])):
                    rows.append((root, no, f"p{p}", rng.choice(["x", "y", None]), rng.choice(["ready", "failed"]), 1, None, T0 + timedelta(seconds=no * 100 + k)))
    heads = [(r, n, n not in (3,)) for r in ("a", "b") for n in range(1, 7) if (r, n) != ("b", 5)] * 2
    rows.append(("a", 2, None, "x", "ready", 1, None, T0))
    assert got(spark, rows + rows[:5], heads) == brute(rows, heads)


def test_complete_snapshot_without_rows_removes_all(spark):
    rows = [("a", 1, "p", "x", "ready", 1, None, T0), ("a", 3, "p", "x", "ready", 1, None, T0)]
    heads = [("a", 1, True), ("a", 2, True), ("a", 3, True)]
    assert got(spark, rows, heads) == {("a", 2, "p", "removed"), ("a", 3, "p", "added")}


def test_empty_tables(spark):
    assert got(spark, [], [("a", 1, True)]) == set()
    assert got(spark, [("a", 1, "p", "x", "ready", 1, None, T0)], []) == set()
