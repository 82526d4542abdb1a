import json

from lodestone.operators import nested
from lodestone.operators.nested import COLLECTIONS, child_table, flatten, parse, visit, write_tables


def cases(record):
    return [(p, k) for _, p, k, _, _ in visit(record, ("extraction", "error"), frozenset(COLLECTIONS))]


def test_shapes_of_collections():
    record = {"extraction": {"windows": [{"a": 1, "peaks": {"bin": 3}}, None, {"peaks": '[{"bin": 1}, null, {"bin": 2}]'}], "other": {"tiles": [{"x": 1}]}}, "error": {"details": {"attempts": [None, {"steps": []}]}}}
    assert cases(record) == [
        ("record", "extraction.windows[0]"),
        ("extraction.windows[0]", "extraction.windows[0].peaks[0]"),
        ("record", "extraction.windows[2]"),
        ("extraction.windows[2]", "extraction.windows[2].peaks[0]"),
        ("extraction.windows[2]", "extraction.windows[2].peaks[2]"),
        ("record", "extraction.other.tiles[0]"),
        ("record", "error.details.attempts[1]"),
    ]
    assert cases({"extraction": json.dumps({"frames": {"x": 1}})}) == [("record", "extraction.frames[0]")]
    assert cases({"extraction": None, "error": {"frames": ["text", 3, None]}}) == []
    assert cases({"windows": [{}]}) == []  # only below extraction and error
    assert cases([1]) == cases("x") == []


def test_deep_bodies_do_not_recurse():
    value = {"x": 1}
    for _ in range(300):
        value = {"windows": [value]}
    assert len(cases({"extraction": value})) == 300
    assert parse("[" * 200_000) is None


def test_payloads_hold_no_collection_at_any_depth():
    record = {"extraction": {"windows": [{"a": [1, {"b": None}], "meta": {"frames": [{"c": 1}], "d": [{"tiles": [{}], "e": 2}]}, "peaks": []}]}}
    rows = [(k, nested._own(v, frozenset(COLLECTIONS))) for _, _, k, _, v in visit(record, ("extraction",), frozenset(COLLECTIONS))]
    assert rows[0] == ("extraction.windows[0]", '{"a": [1, {"b": null}], "meta": {"d": [{"e": 2}]}}')
    assert [k for k, _ in rows[1:]] == ["extraction.windows[0].meta.frames[0]", "extraction.windows[0].meta.d[0].tiles[0]"]


def test_unreadable_bodies():
    assert parse(None) is parse("") is parse('{"a": NaN}') is parse('{"a": 1} x') is None


def test_latest_body_counts_and_tables_join(spark, tmp_path):
    rows = [
        (1, "r", "2025-01-01 00:00:00", '{"extraction": {"windows": [{"start": 1, "peaks": [{"bin": 5}]}]}}'),
        (1, "r", "2025-01-02 00:00:00", '{"extraction": {"windows": [{"start": 2.5}, {"start": 3, "peaks": [{"bin": 7}]}]}}'),
        (1, "r", "2025-01-02 00:00:00", '{"extraction": {"windows": [{"start": 2.5}, {"start": 3, "peaks": [{"bin": 7}]}]}}'),
        (2, None, "2025-01-01 00:00:00", "{broken"),
        (3, None, None, None),
    ]
    raw = spark.createDataFrame([(a, b, c, d) for a, b, c, d in rows], "raw_id long, root string, received_at string, body string").selectExpr("raw_id", "root", "cast(received_at as timestamp) received_at", "body", "root as tag")
    flat = flatten(raw)
    assert {(r.raw_id, r.parent_key, r.child_key) for r in flat.collect()} == {(1, "record", "extraction.windows[0]"), (1, "record", "extraction.windows[1]"), (1, "extraction.windows[1]", "extraction.windows[1].peaks[0]")}
    write_tables(flat, str(tmp_path / "t"))
    again = spark.read.parquet(str(tmp_path / "t"))
    windows = child_table(again, "windows", "start double")
    peaks = child_table(again, "peaks", "bin long")
    joined = peaks.join(windows.selectExpr("raw_id", "child_key as parent_key", "start"), ["raw_id", "parent_key"])
    assert [(r.bin, r.start) for r in joined.select("bin", "start").collect()] == [(7, 3.0)]
    assert flatten(raw.where("false")).count() == 0
