import json
import os
import threading
import time

import numpy as np
import pytest

from lodestone.functions.text import TextFailure
from lodestone.plans.encode_table import encode_rows
from lodestone.plans.engine import CancellationToken, EncodeRequest, Engine, EngineConfig, checked, default_readers
from lodestone.session import materialize
from lodestone.sources import directory, vector_file
from lodestone.types import LodestoneError
from tests.test_functions import BODY, package, tone, wav


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    (root / "sub" / ".hid").mkdir(parents=True)
    files = {"b.txt": b"hello there", "a.txt": b"other text", "sub/.hid/copy.txt": b"hello there", "_under": b"third one", "bad.bin": b"\x00\xff bad", "x.7z": b"7z\xbc\xaf\x27\x1c..", "empty": b"", "d.docx": package(BODY), "t.wav": wav(tone(440)), "p.png": b"\x89PNG\r\n\x1a\n.."}
    for name, content in files.items():
        (root / name).write_bytes(content)
    os.symlink("a.txt", root / "link")
    with open(os.path.join(os.fsencode(root), b"n\xff.txt"), "wb") as f:
        f.write(b"name that is no text")
    return root


def by_path(result):
    return {bytes(r.path_bytes): r for r in result.records.collect()}


def test_states_reuse_and_counters(spark, tree):
    result = Engine(spark).encode(EncodeRequest(str(tree)))
    rows = by_path(result)
    assert {k: r.state for k, r in rows.items()} == {
        b"a.txt": "ready", b"b.txt": "ready", b"sub/.hid/copy.txt": "ready", b"_under": "ready", b"bad.bin": "failed", b"x.7z": "unsupported",
        b"empty": "failed", b"d.docx": "ready", b"t.wav": "ready", b"p.png": "failed", b"link": "skipped", b"n\xff.txt": "ready",
    }
    assert rows[b"sub/.hid/copy.txt"].reused and not rows[b"b.txt"].reused
    assert rows[b"n\xff.txt"].path is None and rows[b"a.txt"].path == "a.txt"
    assert rows[b"p.png"].error.code == "runtime_unavailable" and rows[b"empty"].error.code == "insufficient_content" and rows[b"bad.bin"].error.code == "invalid_text"
    assert all(r.file_id for k, r in rows.items() if k != b"link")
    s = result.summary
    assert (s["files_ready"], s["vectors_encoded"], s["cache_hits"], s["files_skipped"], s["files_failed"]) == (7, 6, 1, 1, 4)
    assert result.complete and result.exit_code == 3
    assert [p["stage"] for p in result.progress][0] == "discovering" and result.progress[-1]["stage"] == "completed"
    order = [bytes(r.path_bytes).split(b"/") for r in result.records.collect()]
    assert order == sorted(order)


def test_second_run_reuses_and_follows_moves(spark, tree, tmp_path):
    engine = Engine(spark)
    first = engine.encode(EncodeRequest(str(tree)))
    vector_file.write_store(first.records, str(tmp_path / "store"))
    saved = vector_file.read_store(spark, str(tmp_path / "store"))
    (tree / "b.txt").rename(tree / "moved.txt")
    (tree / "sub" / ".hid" / "copy.txt").unlink()
    stat = (tree / "a.txt").stat()
    (tree / "a.txt").write_bytes(b"OTHER text")
    os.utime(tree / "a.txt", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    second = engine.encode(EncodeRequest(str(tree)), saved)
    rows = by_path(second)
    assert b"b.txt" not in rows and rows[b"moved.txt"].reused and not rows[b"a.txt"].reused
    assert second.summary["vectors_encoded"] == 1 and second.summary["cache_hits"] == 5


def test_batches_cancellation_and_exclusion(spark, tree):
    token = CancellationToken()
    result = Engine(spark, EngineConfig(batches=3)).encode(EncodeRequest(str(tree)), cancel=token, progress=lambda p: token.cancel() if p.get("files_processed") else None)
    assert result.summary["cancelled"] and not result.complete and result.exit_code == 130
    assert 0 < result.records.count() < 12
    whole = Engine(spark, EngineConfig(batches=3)).encode(EncodeRequest(str(tree), exclude=(str(tree / "sub"), "x.7z")))
    assert whole.complete and set(by_path(whole)).isdisjoint({b"x.7z", b"sub/.hid/copy.txt"})


def test_failing_reader_loses_only_its_file(spark, tree):
    def broken(content):
        raise ZeroDivisionError("no")

    result = Engine(spark, readers=default_readers() | {("audio", "media"): broken}).encode(EncodeRequest(str(tree)))
    assert by_path(result)[b"t.wav"].error.code == "worker_failed" and result.summary["files_ready"] == 6


def test_vectors_of_readers_are_checked(spark, tree):
    unit = np.zeros(4096, np.float32)
    unit[3] = 1
    for bad in (unit * 2, unit[:5], unit * np.nan, "none", None):
        with pytest.raises(TextFailure) as e:
            checked(bad, 4096)
        assert e.value.code == "worker_failed"
    result = Engine(spark, readers=default_readers() | {("audio", "media"): lambda c: (unit * 2, {}), ("image", "raster"): lambda c: (unit[:512], {})}).encode(EncodeRequest(str(tree)))
    rows = by_path(result)
    assert rows[b"t.wav"].error.code == "worker_failed" and rows[b"p.png"].state == "ready"


def test_budgets_by_family(spark, tree):
    rows = by_path(Engine(spark, EngineConfig(memory_bytes=300 << 20)).encode(EncodeRequest(str(tree))))
    assert rows[b"d.docx"].state == rows[b"t.wav"].state == rows[b"a.txt"].state == "ready"
    assert (rows[b"p.png"].error.code, rows[b"p.png"].error.stage) == ("resource_budget_too_small", "runtime")
    rows = by_path(Engine(spark, EngineConfig(memory_bytes=200 << 20, staging_bytes=1000)).encode(EncodeRequest(str(tree))))
    assert (rows[b"t.wav"].error.code, rows[b"t.wav"].error.stage) == ("resource_budget_too_small", "staging")
    assert rows[b"d.docx"].error.stage == "runtime" and rows[b"a.txt"].state == "ready"


def test_a_reader_has_a_deadline(spark, tree):
    def slow(content):
        time.sleep(30)

    began = time.monotonic()
    result = Engine(spark, EngineConfig(deadline=0.3), default_readers() | {("audio", "media"): slow}).encode(EncodeRequest(str(tree)))
    assert by_path(result)[b"t.wav"].error.code == "worker_timeout" and time.monotonic() - began < 25
    assert result.summary["files_ready"] == 6


def test_a_running_batch_is_cancelled(spark, tree):
    def slow(content):
        time.sleep(15)

    token, began = CancellationToken(), time.monotonic()
    threading.Timer(4.0, token.cancel).start()
    result = Engine(spark, readers=default_readers() | {("text", "utf8"): slow}).encode(EncodeRequest(str(tree)), cancel=token)
    assert time.monotonic() - began < 14 and result.exit_code == 130 and not result.complete
    assert result.summary["files_processed"] == 0 and result.summary["files_total"] == 12 and result.progress[-1]["stage"] == "cancelled"
    assert sum(p["stage"] == "encoding" for p in result.progress) > 5  # it tells that it is alive


def test_a_cancel_after_all_work_changes_nothing(spark, tree):
    token = CancellationToken()
    result = Engine(spark).encode(EncodeRequest(str(tree)), cancel=token, progress=lambda p: token.cancel() if p.get("files_processed") else None)
    assert result.complete and result.exit_code == 3 and result.progress[-1]["stage"] == "completed"


def test_copies_are_read_where_the_first_cannot_be(spark, tree, monkeypatch):
    # b.txt is the least path of its content; it changes between hashing and reading.
    classified = Engine._classified

    def and_change(self, scanned):
        out = materialize(classified(self, scanned))
        (tree / "b.txt").write_bytes(b"HELLO there")
        return out

    monkeypatch.setattr(Engine, "_classified", and_change)
    rows = by_path(Engine(spark).encode(EncodeRequest(str(tree))))
    assert rows[b"b.txt"].error.code == "source_changed" and rows[b"b.txt"].file_id is None
    assert rows[b"sub/.hid/copy.txt"].state == "ready" and not rows[b"sub/.hid/copy.txt"].reused


def test_a_path_that_leads_elsewhere_has_changed(tree, monkeypatch):
    root = directory.resolve_root(str(tree))
    row = directory.read_file(root, b"a.txt")
    read = os.read

    def rename_over(fd, n):
        if not (tree / "a.txt").samefile(tree / "b.txt"):
            (tree / "a.txt").unlink()
            os.link(tree / "b.txt", tree / "a.txt")
        return read(fd, n)

    monkeypatch.setattr(os, "read", rename_over)
    assert directory.read_again(root, b"a.txt", row[3:10], 1 << 20) == (None, "source_changed")


def test_source_change_drops_identity(tree):
    root = directory.resolve_root(str(tree))
    row = directory.read_file(root, b"a.txt")
    expected = row[3:10]
    assert directory.read_again(root, b"a.txt", expected, 1 << 20) == (b"other text", None)
    (tree / "a.txt").write_bytes(b"changed now")
    assert directory.read_again(root, b"a.txt", expected, 1 << 20) == (None, "source_changed")
    assert directory.read_again(root, b"b.txt", directory.read_file(root, b"b.txt")[3:10], 3) == (None, "resource_budget_too_small")
    os.symlink("b.txt", tree / "sneaky")
    assert directory.read_file(root, b"sneaky")[-3] == "source_changed"


def test_roots(tmp_path):
    os.symlink(tmp_path, tmp_path / "self")
    for bad in ("relative", str(tmp_path / "self"), str(tmp_path / "absent")):
        with pytest.raises(LodestoneError):
            directory.resolve_root(bad)


def test_empty_directory_and_config(spark, tmp_path):
    (tmp_path / "e").mkdir()
    result = Engine(spark).encode(EncodeRequest(str(tmp_path / "e")))
    assert result.records.count() == 0 and result.complete and result.exit_code == 0
    for bad in ({"workers": 0}, {"memory_bytes": 0}, {"backend": "x"}):
        with pytest.raises(LodestoneError):
            EngineConfig(**bad)


def test_json_round_trip_and_strictness(spark, tree, tmp_path):
    result = Engine(spark).encode(EncodeRequest(str(tree)))
    bundle = vector_file.bundle_of(result.records, str(tree), result.summary, result.complete)
    path = str(tmp_path / "out.json")
    vector_file.write_json(path, bundle)
    vector_file.write_json(path, bundle)  # a valid result may be replaced
    again = vector_file.read_json(path)
    assert again == json.loads(json.dumps(bundle))
    assert vector_file.records_of(spark, again).where("state = 'ready'").count() == 7
    data = open(path, "rb").read()
    assert data.endswith(b"\n") and b"posix_bytes" in data
    ready = next(i for i, f in enumerate(again["files"]) if f["state"] == "ready")

    def spoiled(change):
        copy = json.loads(data)
        change(copy)
        return json.dumps(copy).encode()

    cases = {
        "version": (spoiled(lambda b: b.update(schema_version=99)), "unsupported_schema_version"),
        "unknown": (spoiled(lambda b: b.update(extra=1)), "invalid_vector_file"),
        "vector": (spoiled(lambda b: b["files"][ready]["vector"].__setitem__(0, 0.5)), "invalid_vector_file"),
        "profile": (spoiled(lambda b: b["files"][ready].update(profile_id="sha256:" + "0" * 64)), "unknown_profile"),
        "path": (spoiled(lambda b: b["files"][ready].update(path="../x")), "invalid_vector_file"),
        "summary": (spoiled(lambda b: b["summary"].update(files_ready=1)), "invalid_vector_file"),
        "reuse": (spoiled(lambda b: b["files"].__setitem__(0, {"path": "zz", "state": "failed", "reused": True})), "invalid_vector_file"),
        "trailing": (data + b"{}", "invalid_vector_file"),
        "twice": (data.replace(b'"complete":', b'"complete":true,"complete":', 1), "invalid_vector_file"),
    }
    for name, (content, code) in cases.items():
        with pytest.raises(LodestoneError) as e:
            vector_file.parse_json(content)
        assert e.value.code == code, name
    (tmp_path / "notes.txt").write_text("keep me")
    with pytest.raises(LodestoneError):
        vector_file.write_json(str(tmp_path / "notes.txt"), bundle)
    assert (tmp_path / "notes.txt").read_text() == "keep me"


def test_the_schema_describes_what_is_written(spark, tree):
    schema = vector_file.json_schema()
    result = Engine(spark).encode(EncodeRequest(str(tree)))
    bundle = json.loads(json.dumps(vector_file.bundle_of(result.records, str(tree), result.summary, result.complete)))

    def check(value, rule, at="$"):
        if "anyOf" in rule:
            return any(check(value, r, at) for r in rule["anyOf"])
        if "enum" in rule:
            return value in rule["enum"]
        if "const" in rule:
            return value == rule["const"]
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}[type(value)]
        if kind != rule["type"] and not (kind == "integer" and rule["type"] == "number"):
            return False
        if kind == "object" and "properties" in rule:
            assert set(rule["required"]) <= set(value) <= set(rule["properties"]), at
            assert all(check(v, rule["properties"][k], f"{at}.{k}") for k, v in value.items()), at
        if kind == "array":
            return all(check(v, rule["items"], f"{at}[]") for v in value[:50])
        return True

    assert check(bundle, schema) and not check(bundle | {"complete": 1}, schema["properties"]["files"])
    assert json.loads(json.dumps(schema, sort_keys=True)) == schema


def test_tables_encode_each_text_once(spark):
    rows = [(3, "same"), (1, "same"), (2, "other"), (4, None), (5, " "), (6, " ")]
    got = {r.id: r for r in encode_rows(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert [got[i].state for i in range(1, 7)] == ["ready", "ready", "ready", "failed", "failed", "failed"]
    assert [got[i].reused for i in range(1, 7)] == [False, False, True, False, False, False]
    assert got[4].error == "io_error" and np.allclose(got[1].vector, got[3].vector)
