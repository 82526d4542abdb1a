"""Result files: one JSON value, read strictly and written atomically; and a Parquet store."""

from __future__ import annotations

import base64
import json
import math
import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

from lodestone.functions.vectors import vector_bytes
from lodestone.profiles import Profile, registry
from lodestone.types import ERROR_CODES, FAMILIES, NORM_TOLERANCE, RECORD, STATES, LodestoneError

FORMAT, VERSION, MAX_BYTES = "lodestone-vectors", 1, 512 << 20
RECORD_KEYS = {"path", "file_id", "bytes", "state", "family", "profile_id", "vector", "vector_sha256", "reused", "error", "extraction"}
COUNTS = ("files_discovered", "files_processed", "files_ready", "files_failed", "files_skipped", "vectors_encoded", "cache_hits", "bytes_read", "bytes_hashed")
SUMMARY_KEYS = {*COUNTS, "files_total", "elapsed_seconds", "backend", "workers", "cancelled"}
TOP_KEYS = {"format", "schema_version", "directory", "complete", "files", "summary"}
ID = re.compile(r"sha256:[0-9a-f]{64}\Z")


def _fail(message: str, code: str = "invalid_vector_file"):
    raise LodestoneError(code, "vectors", message)


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        _fail("a key came twice")
    return out


def path_value(path: bytes) -> object:
    """A path in JSON: its text, or its bytes in base64 where it is not UTF-8."""
    try:
        return path.decode()
    except UnicodeDecodeError:
        return {"encoding": "posix_bytes", "base64": base64.b64encode(path).decode()}


def path_of(value: object) -> bytes:
    if isinstance(value, str):
        out = value.encode("utf-8", "strict")
    elif isinstance(value, dict) and set(value) == {"encoding", "base64"} and value["encoding"] == "posix_bytes":
        try:
            out = base64.b64decode(value["base64"], validate=True)
        except (ValueError, TypeError):
            _fail("a path is no base64")
    else:
        _fail("a path is neither text nor encoded bytes")
    return out if b"\0" not in out else _fail("NUL in a path")


def _keys(value: object, allowed: set[str], required: set[str], what: str) -> dict:
    if not isinstance(value, dict):
        _fail(f"{what} is no object")
    if not set(value) <= allowed or not required <= set(value):
        _fail(f"{what} has unknown or missing fields")
    return value


def _whole(value: object, what: str) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or not 0 <= value < 1 << 64:
        _fail(f"{what} is no whole number")
    return value


def validate(bundle: dict, profiles: list[Profile] | None = None) -> None:
    """Every invariant of a result; raises LodestoneError at the first that fails."""
    _keys(bundle, TOP_KEYS, TOP_KEYS, "the file")
    if bundle["format"] != FORMAT:
        _fail("not a vector file")
    if bundle["schema_version"] != VERSION:
        _fail("unsupported schema version", "unsupported_schema_version")
    if not path_of(bundle["directory"]).startswith(b"/"):
        _fail("the directory is no absolute path")
    if not isinstance(bundle["files"], list) or not isinstance(bundle["complete"], bool):
        _fail("files or complete have another type")
    by_id = {p.profile_id: p for p in profiles or registry()}
    paths, digests = set(), {}
    for record in bundle["files"]:
        _record(record, by_id, paths, digests)
    _summary(bundle)


def _record(record: dict, by_id: dict[str, Profile], paths: set, digests: dict) -> None:
    _keys(record, RECORD_KEYS, {"path", "state", "reused"}, "a record")
    path = path_of(record["path"])
    if path in paths or not path or any(part in (b"", b".", b"..") for part in path.split(b"/")):
        _fail("paths must be relative, plain and unique")
    paths.add(path)
    get = record.get
    if get("state") not in STATES or not isinstance(get("reused"), bool) or get("family") is not None and not isinstance(get("family"), str):
        _fail("state, reused or family have another value")
    if get("file_id") is not None and not (isinstance(get("file_id"), str) and ID.match(get("file_id"))):
        _fail("file_id is no digest")
    if get("bytes") is not None:
        _whole(get("bytes"), "bytes")
    if get("error") is not None:
        error = _keys(get("error"), {"code", "stage", "message", "details"}, {"code", "stage", "message"}, "an error")
        if error["code"] not in ERROR_CODES:
            _fail("unknown error code")
    if record["state"] != "ready":
        if get("vector") is not None or get("vector_sha256") is not None or record["reused"] or get("error") is None:
            _fail("what is not ready has an error, no vector and no reuse")
        return
    if any(get(k) is None for k in ("file_id", "profile_id", "bytes", "vector", "vector_sha256")) or get("error") is not None:
        _fail("what is ready has identity, size, vector and digest, and no error")
    profile = by_id.get(record["profile_id"])
    if profile is None:
        _fail("unknown profile", "unknown_profile")
    vector = record["vector"]
    if get("family") != profile.family or not isinstance(vector, list) or len(vector) != profile.dimensions or not all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in vector):
        _fail("the vector doesn't fit its profile")
    data = vector_bytes(vector)
    import hashlib

    import numpy as np

    wide = np.frombuffer(data, "<f4").astype(np.float64)
    if abs(float((wide * wide).sum()) - 1) > NORM_TOLERANCE:
        _fail("the vector has no unit length")
    if hashlib.sha256(data).hexdigest() != record["vector_sha256"]:
        _fail("the vector's digest is another")
    if digests.setdefault((record["file_id"], record["profile_id"]), record["vector_sha256"]) != record["vector_sha256"]:
        _fail("one content has two vectors")


def _summary(bundle: dict) -> None:
    s = _keys(bundle["summary"], SUMMARY_KEYS, SUMMARY_KEYS - {"files_total"}, "the summary")
    for k in COUNTS:
        _whole(s[k], k)
    files = bundle["files"]
    ready = sum(f["state"] == "ready" for f in files)
    skipped = sum(f["state"] == "skipped" for f in files)
    reused = sum(f["reused"] for f in files)
    total = s.get("files_total")
    fits = (
        (s["files_processed"], s["files_ready"], s["files_skipped"], s["files_failed"]) == (len(files), ready, skipped, len(files) - ready - skipped)
        and (s["cache_hits"], s["vectors_encoded"]) == (reused, ready - reused)
        and s["files_discovered"] >= len(files)
        and total in (None, s["files_discovered"])
        and (not bundle["complete"] or total == len(files))
        and not (s["cancelled"] and bundle["complete"])
        and s["bytes_read"] >= s["bytes_hashed"]
        and isinstance(s["workers"], int)
        and 1 <= s["workers"] <= 64
        and isinstance(s["elapsed_seconds"], (int, float))
        and math.isfinite(s["elapsed_seconds"])
        and s["elapsed_seconds"] >= 0
    )
    if not fits:
        _fail("the summary doesn't agree with the records")


def json_schema() -> dict:
    """The JSON schema of a result file, made from the same sets that validate() reads."""
    whole, text = {"type": "integer", "minimum": 0}, {"type": "string"}
    digest = {"type": "string", "pattern": "^sha256:[0-9a-f]{64}$"}
    encoded = {"type": "object", "properties": {"encoding": {"const": "posix_bytes"}, "base64": text}, "required": ["base64", "encoding"], "additionalProperties": False}
    path = {"anyOf": [text, encoded]}
    anything = {"anyOf": [{"type": t} for t in ("object", "array", "string", "number", "boolean", "null")]}
    error = {
        "type": "object", "properties": {"code": {"enum": list(ERROR_CODES)}, "stage": text, "message": text, "details": anything},
        "required": ["code", "message", "stage"], "additionalProperties": False,
    }
    fields = {
        "path": path, "file_id": digest, "bytes": whole, "state": {"enum": list(STATES)}, "family": {"enum": list(FAMILIES)}, "profile_id": digest,
        "vector": {"type": "array", "items": {"type": "number"}}, "vector_sha256": {"type": "string", "pattern": "^[0-9a-f]{64}$"},
        "reused": {"type": "boolean"}, "error": error, "extraction": anything,
    }
    record = {"type": "object", "properties": fields, "required": ["path", "reused", "state"], "additionalProperties": False}
    counts = {k: whole for k in COUNTS} | {"files_total": {"anyOf": [whole, {"type": "null"}]}, "elapsed_seconds": {"type": "number", "minimum": 0}}
    counts |= {"backend": text, "workers": {"type": "integer", "minimum": 1, "maximum": 64}, "cancelled": {"type": "boolean"}}
    summary = {"type": "object", "properties": counts, "required": sorted(SUMMARY_KEYS - {"files_total"}), "additionalProperties": False}
    top = {"format": {"const": FORMAT}, "schema_version": {"const": VERSION}, "directory": path, "complete": {"type": "boolean"}, "files": {"type": "array", "items": record}, "summary": summary}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": FORMAT, "type": "object", "properties": top, "required": sorted(TOP_KEYS), "additionalProperties": False}


def read_json(path: str, profiles: list[Profile] | None = None) -> dict:
    """The one JSON value of a result file: no repeated or unknown field, nothing after it."""
    try:
        st = os.lstat(path)
        if not os.path.isfile(path) or os.path.islink(path) or st.st_size > MAX_BYTES:
            _fail("no regular file, or too large")
        with open(path, "rb") as f:
            data = f.read(MAX_BYTES + 1)
        if os.lstat(path).st_mtime_ns != st.st_mtime_ns or len(data) != st.st_size:
            _fail("the file changed while it was read")
    except OSError as e:
        raise LodestoneError("io_error", "vectors", str(e)) from None
    return parse_json(data, profiles)


def parse_json(data: bytes, profiles: list[Profile] | None = None) -> dict:
    try:
        bundle = json.loads(data.decode("utf-8", "strict"), object_pairs_hook=_unique, parse_constant=lambda _: _fail("no JSON number"))
    except (ValueError, RecursionError) as e:
        raise LodestoneError("invalid_vector_file", "vectors", f"no JSON value: {e}") from None
    validate(bundle, profiles)
    return bundle


def write_json(path: str, bundle: dict, profiles: list[Profile] | None = None) -> None:
    """Validate, write beside the target, sync and rename; only a valid result is replaced."""
    validate(bundle, profiles)
    before = None
    if os.path.lexists(path):
        read_json(path, profiles)
        before = os.lstat(path).st_mtime_ns
    data = json.dumps(bundle, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode() + b"\n"
    if len(data) > MAX_BYTES:
        _fail("the result is too large for one file")
    folder = os.path.dirname(os.path.abspath(path))
    fd, staged = tempfile.mkstemp(dir=folder, prefix=".vectors-")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if before is None:
            os.link(staged, path)  # fails where the target appeared meanwhile
            os.unlink(staged)
        else:
            if os.lstat(path).st_mtime_ns != before:
                _fail("the target changed meanwhile")
            os.replace(staged, path)
    except FileExistsError:
        os.unlink(staged)
        _fail("the target appeared meanwhile")
    except BaseException:
        if os.path.exists(staged):
            os.unlink(staged)
        raise
    at = os.open(folder, os.O_RDONLY | os.O_DIRECTORY)
    try:
        os.fsync(at)
    finally:
        os.close(at)


def records_of(spark: SparkSession, bundle: dict) -> DataFrame:
    """The records of a result as a table."""
    rows = []
    for r in bundle["files"]:
        path = path_of(r["path"])
        error = r.get("error")
        details = None if error is None or error.get("details") is None else json.dumps(error["details"])
        rows.append(
            (
                bytearray(path), r["path"] if isinstance(r["path"], str) else None, r.get("file_id"), r.get("bytes"), r["state"], r.get("family"), r.get("profile_id"),
                None if r.get("vector") is None else [float(x) for x in r["vector"]], r.get("vector_sha256"), r["reused"],
                None if error is None else (error["code"], error["stage"], error["message"], details), None if r.get("extraction") is None else json.dumps(r["extraction"]),
            )
        )
    return spark.createDataFrame(rows, RECORD)


def bundle_of(records: DataFrame, directory: str, summary: dict, complete: bool) -> dict:
    """A result as one JSON value, for exports that fit one file; records sorted by path."""
    files = []
    for r in records.toLocalIterator():
        d = r.asDict(recursive=True)
        path = bytes(d.pop("path_bytes"))
        d["path"] = path_value(path)
        if d["error"] is not None:
            d["error"] = {k: (json.loads(v) if k == "details" else v) for k, v in d["error"].items() if v is not None}
        if d["extraction"] is not None:
            d["extraction"] = json.loads(d["extraction"])
        files.append((path.split(b"/"), {k: v for k, v in d.items() if v is not None}))
    files.sort(key=lambda f: f[0])
    return {"format": FORMAT, "schema_version": VERSION, "directory": directory, "complete": complete, "files": [f for _, f in files], "summary": summary}


def write_store(records: DataFrame, path: str) -> None:
    """Keep ready records for reuse, partitioned by profile; no limit of size."""
    records.where("state = 'ready'").write.partitionBy("profile_id").mode("overwrite").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


__all__ = ["FAMILIES", "bundle_of", "json_schema", "parse_json", "path_of", "path_value", "read_json", "read_store", "records_of", "validate", "write_json", "write_store"]
