"""The queries of this subpackage on the test tables: SQL by brute force, recall, agreement."""

import os
import sys

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from lodestone.llm.queries import QUERIES, SQL  # noqa: E402
from lodestone.session import table  # noqa: E402
from tests.llm.test_vectors import brute_admit  # noqa: E402

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(LARGER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{LARGER}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(set(SQL) - {"p7_batches"}))
def test_recall_against_brute_force(spark, duck, name):
    frame = duck.execute(SQL[name]).df()
    want = set(map(tuple, frame.to_numpy().tolist()))
    rows = [tuple(r) for r in QUERIES[name](spark, LARGER).select(*frame.columns).collect()]
    assert len(rows) == len(set(rows)) and set(rows) <= want and len(rows) >= 0.99 * len(want) > 100


def test_admission_of_the_table(spark, sf, monkeypatch):
    rows = [(r.record_id, r.batch_no, r.file_id, r.profile_id, r.state, r.vector) for r in table(spark, sf, "file_record").collect()]
    dims = {r.profile_id: r.dimensions for r in table(spark, sf, "encoding_profile").collect()}
    monkeypatch.setattr("tests.llm.test_vectors.PROFILES", list(dims.items()))
    want = brute_admit(rows)
    found = {r.record_id: r.match_id for r in QUERIES["p7_found"](spark, sf).collect()}
    assert sum(found.get(k) == v for k, v in want.items()) >= 0.99 * len(want) and found.keys() <= want.keys() and len(want) > 20
    assert {r.record_id: r.match_id for r in QUERIES["p7_batches"](spark, sf).collect()} == found


def test_shares_of_the_mixture(spark):
    report = {r.source: r for r in QUERIES["p9_shares"](spark, LARGER).collect()}
    live = {s: r for s, r in report.items() if r.target_share and r.tokens}
    whole = sum(r.target_share for r in live.values())
    longest = 12_000  # tokens of one document, at most
    total = sum(r.used_tokens for r in report.values())
    assert all(abs(r.used_tokens - r.target_share / whole * total) <= 0.02 * r.target_share / whole * total + min(longest, r.tokens / r.documents * 3) for r in live.values())
    assert all(r.most_repeats <= r.max_repeats for r in live.values()) and np.isclose(sum(r.actual_share for r in report.values()), 1)
