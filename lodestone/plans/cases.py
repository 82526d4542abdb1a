"""Queries of readers, sources and the engine over stated cases, with what must come out.

The test tables hold no files: these queries make the few they need, and their SQL states
the outcome of each case as written down in advance.
"""

from __future__ import annotations

import base64
import io
import json
import math
import os
import shutil
import struct
import uuid
import wave
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import identity as I
from lodestone.functions.audio import triple_hash, sound_outcomes
from lodestone.functions.docx import package_texts
from lodestone.functions.raster import raster_outcomes
from lodestone.functions.text import text_vectors
from lodestone.plans.engine import CancellationToken, EncodeRequest, Engine, EngineConfig
from lodestone.profiles import profile_id
from lodestone.session import materialize, scratch_dir, table
from lodestone.sources import directory, vector_file
from lodestone.types import ERROR_CODES, LodestoneError

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _values(columns: str, rows: list[tuple]) -> str:
    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        return f"{x}::BIGINT" if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({columns})"


_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _package(xml: str, comment: bytes = b"", parts: tuple[str, ...] = ("[Content_Types].xml", "word/document.xml")) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for part in parts:
            z.writestr(zipfile.ZipInfo(part), xml)
        z.comment = comment
    return out.getvalue()


def _document(inner: str, name: str = "document") -> str:
    return f'<w:{name} xmlns:w="{_WORD}">{inner}</w:{name}>'


_BODY = "<w:body><w:p><w:r><w:t>Sun &amp; rain&#33;</w:t><w:tab/><w:t>again</w:t></w:r><w:del><w:r><w:t>cut</w:t></w:r></w:del></w:p><w:p/></w:body>"


def _volumes(content: bytes) -> bytes:
    at = content.rindex(b"PK\5\6")
    return content[: at + 4] + struct.pack("<H", 1) + content[at + 6 :]


def _packages() -> dict[str, bytes | None]:
    return {
        "plain": _package(_document(_BODY)),
        "with a comment": _package(_document(_BODY), b"made by hand"),
        "text outside the body": _package(_document("<w:t>no</w:t><w:body><w:p><w:t>yes</w:t></w:p></w:body><w:t>no</w:t>")),
        "text box": _package(_document("<w:body><w:p><w:t>a</w:t><w:txbxContent><w:p><w:t>b</w:t></w:p></w:txbxContent></w:p></w:body>")),
        "other root": _package(_document("<w:body><w:t>x</w:t></w:body>", "hdr")),
        "no body": _package(_document("<w:p><w:t>x</w:t></w:p>")),
        "document type": _package("<!DOCTYPE a><a/>"),
        "cut off": _package(_document(_BODY)[:-9]),
        "too deep": _package(_document("<w:body>" + "<w:p>" * 300 + "</w:p>" * 300 + "</w:body>")),
        "another package": _package("<a/>", parts=("a.xml",)),
        "several volumes": _volumes(_package(_document(_BODY))),
        "bytes after the end": _package(_document(_BODY)) + b"\0",
        "no package": b"PK\3\4",
        "nothing": None,
    }


@query(
    _values(
        "name, text, error",
        [
            ("plain", "Sun & rain!\tagain\n\n", None), ("with a comment", "Sun & rain!\tagain\n\n", None), ("text outside the body", "yes\n", None), ("text box", "a\n", None),
            ("other root", None, "decode_failed"), ("no body", None, "decode_failed"), ("document type", None, "decode_failed"), ("cut off", None, "decode_failed"),
            ("too deep", None, "resource_budget_too_small"), ("another package", None, "unsupported_format"), ("several volumes", None, "unsupported_format"),
            ("bytes after the end", None, "decode_failed"), ("no package", None, "decode_failed"), ("nothing", None, None),
        ],
    )
)
def q31_docx_text(spark: SparkSession, d: str) -> DataFrame:
    """Body text of word-processing packages, or why there is none."""
    rows = [(n, None if c is None else bytearray(c)) for n, c in _packages().items()]
    return spark.createDataFrame(rows, "name string, content binary").select("name", package_texts("content").alias("o")).select("name", "o.text", "o.error")


_BYTES = {
    "plain": b"one line\n", "mark dropped": b"\xef\xbb\xbfone line\r\n", "mark kept inside": "a﻿b".encode(), "composed": "résumé\r".encode(),
    "bad byte": b"a \xff", "overlong": b"\xc0\xaf", "half a pair": b"\xed\xa0\x80", "NUL": b"a\0b", "empty": b"", "white space": "  \r\n　".encode(),
    "1024 marks": ("a" + "́" * 1024).encode(), "1025 marks": ("a" + "́" * 1025).encode(),
}


@query(
    _values(
        "name, state, characters, error",
        [
            ("plain", "ready", 9, None), ("mark dropped", "ready", 9, None), ("mark kept inside", "ready", 3, None), ("composed", "ready", 7, None),
            ("bad byte", "failed", -1, "invalid_text"), ("overlong", "failed", -1, "invalid_text"), ("half a pair", "failed", -1, "invalid_text"), ("NUL", "failed", -1, "invalid_text"),
            ("empty", "failed", -1, "insufficient_content"), ("white space", "failed", -1, "insufficient_content"),
            ("1024 marks", "ready", 1024, None), ("1025 marks", "failed", -1, "invalid_text"),
        ],
    )
)
def q32_utf8_bytes(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of bytes that should be text."""
    rows = spark.createDataFrame([(n, bytearray(c)) for n, c in _BYTES.items()], "name string, content binary")
    return rows.select("name", text_vectors("content").alias("o")).select("name", "o.state", F.coalesce("o.characters", F.lit(-1)).alias("characters"), "o.error")


def _wav(samples: np.ndarray, rate: int = 16_000, width: int = 2, channels: int = 1) -> bytes:
    out = io.BytesIO()
    scaled = np.repeat(samples, channels) * ((1 << (8 * width - 1)) - 1)
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(scaled.astype(f"<i{width}").tobytes())
    return out.getvalue()


def _aiff(samples: np.ndarray) -> bytes:
    data = (samples * 32767).astype(">i2").tobytes()
    form = b"COMM" + struct.pack(">IHIHHQ", 18, 1, len(samples), 16, 16383 + 13, 16_000 << 50) + b"SSND" + struct.pack(">III", len(data) + 8, 0, 0) + data
    return b"FORM" + struct.pack(">I", len(form) + 4) + b"AIFF" + form


def _tone(seconds: float, rate: int = 16_000) -> np.ndarray:
    t = np.arange(int(seconds * rate)) / rate
    return 0.5 * np.sin(2 * np.pi * 440 * t + 3 * np.sin(2 * np.pi * 0.7 * t))


@query(
    _values(
        "name, state, dimensions, windows, enough, error",
        [
            ("tone", "ready", 4096, 1, True, None), ("32 bits, two channels", "ready", 4096, 1, True, None), ("twenty seconds", "ready", 4096, 3, True, None),
            ("silence", "failed", -1, -1, False, "insufficient_content"), ("too short", "failed", -1, -1, False, "insufficient_content"),
            ("other rate", "ready", 4096, 1, True, None), ("no samples in it", "failed", -1, -1, False, "decode_failed"), ("no sound", "failed", -1, -1, False, "runtime_unavailable"),
            ("AIFF", "ready", 4096, 1, True, None), ("AU", "ready", 4096, 1, True, None), ("CAF", "ready", 4096, 1, True, None), ("float", "ready", 4096, 1, True, None),
        ],
    )
)
def q33_sound_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of PCM sound: state, windows, and whether there are landmarks enough."""
    files = {
        "tone": _wav(_tone(3)), "32 bits, two channels": _wav(_tone(3), width=4, channels=2), "twenty seconds": _wav(_tone(20)), "silence": _wav(np.zeros(48_000)),
        "too short": _wav(_tone(0.05)), "other rate": _wav(_tone(3, 44_100), 44_100), "no samples in it": b"RIFF....WAVEjunk", "no sound": b"ID3..",
        "AIFF": _aiff(_tone(3)), "AU": b".snd" + struct.pack(">5I", 24, 0xFFFFFFFF, 3, 16_000, 1) + (_tone(3) * 32767).astype(">i2").tobytes(),
        "CAF": b"caff\0\1\0\0" + struct.pack(">4sqd4s5I", b"desc", 32, 16_000.0, b"lpcm", 2, 2, 1, 1, 16) + struct.pack(">4sqI", b"data", -1, 0) + (_tone(3) * 32767).astype("<i2").tobytes(),
        "float": b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, 16_000, 64_000, 4, 32) + b"data" + struct.pack("<I", 192_000) + _tone(3).astype("<f4").tobytes(),
    }
    rows = spark.createDataFrame([(n, bytearray(c)) for n, c in files.items()], "name string, content binary")
    return rows.select("name", sound_outcomes("content").alias("o")).select("name", "o.state", *[F.coalesce(f"o.{c}", F.lit(-1)).alias(c) for c in ("dimensions", "windows")], F.coalesce(F.col("o.landmarks") > 32, F.lit(False)).alias("enough"), "o.error")


_MIX = "xor({0}, {0} >> {1})"


def _times(h: str, factor: int) -> str:
    return f"(({h})::UHUGEINT * {factor}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"


@query(
    f"""WITH t AS (SELECT p AS pattern, a, b, c FROM (SELECT unnest(range(0, 4)) AS p), (SELECT unnest([3, 64, 128]::BIGINT[]) AS a), (SELECT unnest([5, 100]::BIGINT[]) AS b), (SELECT unnest([7, 90]::BIGINT[]) AS c)),
s AS (SELECT *, {_times("xor(14695981039346656037::UBIGINT, pattern::UBIGINT)", 1099511628211)} AS h0 FROM t),
s1 AS (SELECT *, {_times("xor(h0, a::UBIGINT)", 1099511628211)} AS h1 FROM s), s2 AS (SELECT *, {_times("xor(h1, b::UBIGINT)", 1099511628211)} AS h2 FROM s1),
s3 AS (SELECT *, {_times("xor(h2, c::UBIGINT)", 1099511628211)} AS h3 FROM s2), m1 AS (SELECT *, {_times(_MIX.format("h3", 30), 0xBF58476D1CE4E5B9)} AS g1 FROM s3),
m2 AS (SELECT *, {_times(_MIX.format("g1", 27), 0x94D049BB133111EB)} AS g2 FROM m1), m3 AS (SELECT *, {_MIX.format("g2", 31)} AS g FROM m2)
SELECT pattern, a, b, c, (g % 4096)::BIGINT AS bucket, (CASE WHEN g < 9223372036854775808::UBIGINT THEN 1 ELSE -1 END)::BIGINT AS sign FROM m3"""
)
def q34_landmark_hash(spark: SparkSession, d: str) -> DataFrame:
    """Bucket and sign of triples of spectral peaks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            h = np.array([triple_hash(int(p), np.array([a]), np.array([b]), np.array([c]))[0] for p, a, b, c in f[["pattern", "a", "b", "c"]].itertuples(index=False)], np.uint64)
            yield f.assign(bucket=(h & np.uint64(4095)).astype(np.int64), sign=1 - 2 * (h >> np.uint64(63)).astype(np.int64))

    triples = [(p, a, b, c) for p in range(4) for a in (3, 64, 128) for b in (5, 100) for c in (7, 90)]
    return spark.createDataFrame(triples, "pattern long, a long, b long, c long").mapInPandas(run, "pattern long, a long, b long, c long, bucket long, sign long")


@query("SELECT profile_id, 'sha256:' || sha256(manifest) AS digest FROM encoding_profile")
def q35_manifest_digest(spark: SparkSession, d: str) -> DataFrame:
    """Identity of each profile from its manifest, whatever order its keys came in."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            turned = [dict(reversed(json.loads(m).items())) for m in f["manifest"]]
            yield pd.DataFrame({"profile_id": f["profile_id"], "digest": [profile_id(m) for m in turned]})

    return table(spark, d, "encoding_profile").select("profile_id", "manifest").mapInPandas(run, "profile_id string, digest string")


@query("SELECT record_id, CASE WHEN root = 'library' OR record_id % 2 = 0 THEN path END AS below FROM file_record WHERE path IS NOT NULL")
def q36_relative_path(spark: SparkSession, d: str) -> DataFrame:
    """Paths below a root; every second record lies in a folder whose name only begins alike."""
    rows = table(spark, d, "file_record").where("path IS NOT NULL")
    inside = (F.col("record_id") % 2 == 0) | (F.col("root") == "library")
    full = F.concat(F.when(inside, F.lit("/data/in/")).otherwise(F.lit("/data/inside/")), "path")
    return rows.select("record_id", I.relative_path(full, "/data/in").alias("below"))


@contextmanager
def _folder(spark: SparkSession) -> Iterator[str]:
    """A folder for files on the shared file system, gone at the end."""
    home = scratch_dir(spark).removeprefix("file://").removeprefix("file:")
    path = os.path.join(home, f"lodestone-files-{uuid.uuid4().hex}")
    os.makedirs(path)
    try:
        yield path
    finally:
        shutil.rmtree(path)


def _tree(path: str) -> str:
    """A small library: copies, hidden files, names that are no text, links, bad content."""
    root = os.path.join(path, "root")
    os.makedirs(os.path.join(root, "sub", ".hidden"))
    os.makedirs(os.path.join(root, "out"))
    files = {
        "a.txt": b"first text", "b.txt": b"second text", "sub/copy.txt": b"second text", "sub/.hidden/c.txt": b"third text", "bad.bin": b"\0\xff", "empty": b"", "x.7z": b"7z\xbc\xaf\x27\x1c",
        "d.docx": _package(_document(_BODY)), "t.wav": _wav(_tone(2)), "p.png": b"\x89PNG\r\n\x1a\n..", "out/left.txt": b"left out", "large.wav": _wav(_tone(10)),
    }
    for name, content in files.items():
        with open(os.path.join(root, name), "wb") as f:
            f.write(content)
    with open(os.path.join(os.fsencode(root), b"n\xff.txt"), "wb") as f:
        f.write(b"a name that is no text")
    os.symlink("a.txt", os.path.join(root, "link"))
    os.link(os.path.join(root, "a.txt"), os.path.join(root, "sub", "hard.txt"))
    return root


def _name() -> Column:
    return F.coalesce("path", F.concat(F.lit("base64:"), F.base64("path_bytes"))).alias("name")


@query(
    _values(
        "name, kind, bytes, sha256, error",
        [
            ("a.txt", "file", 10, True, None), ("b.txt", "file", 11, True, None), ("sub/copy.txt", "file", 11, True, None), ("sub/.hidden/c.txt", "file", 10, True, None), ("bad.bin", "file", 2, True, None),
            ("empty", "file", 0, True, None), ("x.7z", "file", 6, True, None), ("p.png", "file", 10, True, None), ("large.wav", "file", 320044, True, None), ("base64:bv8udHh0", "file", 22, True, None),
            ("link", "other", -1, False, "unsupported_format"), ("sub/hard.txt", "file", 10, True, None),
        ],
    )
)
def q37_directory_scan(spark: SparkSession, d: str) -> DataFrame:
    """Everything below a root but what is excluded, no link followed, no name lost."""
    with _folder(spark) as path:
        root = _tree(path)
        rows = directory.scan(spark, root, [os.path.join(root, "out"), "d.docx", "t.wav"])
        return materialize(rows.select(_name(), "kind", F.coalesce("bytes", F.lit(-1)).alias("bytes"), F.col("file_id").isNotNull().alias("sha256"), F.col("error_code").alias("error")))


_SMALL = EngineConfig(staging_bytes=150_000)


def _outcomes(result) -> DataFrame:
    return result.records.select(_name(), "state", "family", "reused", F.coalesce(F.size("vector"), F.lit(-1)).cast("long").alias("dimensions"), F.col("error.code").alias("error"))


@query(
    _values(
        "name, state, family, reused, dimensions, error",
        [
            ("a.txt", "ready", "text", False, 4096, None), ("b.txt", "ready", "text", False, 4096, None), ("sub/copy.txt", "ready", "text", True, 4096, None), ("sub/hard.txt", "ready", "text", True, 4096, None),
            ("sub/.hidden/c.txt", "ready", "text", False, 4096, None), ("bad.bin", "failed", "text", False, -1, "invalid_text"), ("empty", "failed", "text", False, -1, "insufficient_content"),
            ("x.7z", "unsupported", None, False, -1, "unsupported_format"), ("d.docx", "ready", "text", False, 4096, None), ("t.wav", "ready", "audio", False, 4096, None),
            ("p.png", "failed", "image", False, -1, "runtime_unavailable"), ("out/left.txt", "ready", "text", False, 4096, None), ("large.wav", "failed", "audio", False, -1, "resource_budget_too_small"),
            ("base64:bv8udHh0", "ready", "text", False, 4096, None), ("link", "skipped", None, False, -1, "unsupported_format"),
        ],
    )
)
def q38_engine_run(spark: SparkSession, d: str) -> DataFrame:
    """A directory encoded: states, copies, failures as rows, admission by size."""
    with _folder(spark) as path:
        return materialize(_outcomes(Engine(spark, _SMALL).encode(EncodeRequest(_tree(path)))))


@query(_values("name, ready, encoded, hits, failed, skipped, complete, exit_code", [("first", 9, 7, 2, 5, 1, True, 3), ("second", 8, 1, 7, 5, 1, True, 3), ("cancelled", 0, 0, 0, 0, 0, False, 130), ("fewer", 1, 1, 0, 0, 0, True, 0)]))
def q39_engine_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a first run, of one that reuses it after changes, of one cancelled before
    it starts to encode, and of one where everything is ready."""
    with _folder(spark) as path:
        root = _tree(path)
        engine, runs = Engine(spark, _SMALL), {}
        runs["first"] = engine.encode(EncodeRequest(root))
        os.rename(os.path.join(root, "b.txt"), os.path.join(root, "moved.txt"))
        os.unlink(os.path.join(root, "out", "left.txt"))
        st = os.stat(os.path.join(root, "sub", ".hidden", "c.txt"))
        with open(os.path.join(root, "sub", ".hidden", "c.txt"), "wb") as f:
            f.write(b"THIRD text")
        os.utime(os.path.join(root, "sub", ".hidden", "c.txt"), ns=(st.st_atime_ns, st.st_mtime_ns))
        runs["second"] = engine.encode(EncodeRequest(root), runs["first"].records)
        token = CancellationToken()
        runs["cancelled"] = engine.encode(EncodeRequest(root), cancel=token, progress=lambda p: token.cancel() if p["stage"] == "encoding" else None)
        keep = [n for n in os.listdir(os.fsencode(root)) if n != b"a.txt"]
        runs["fewer"] = engine.encode(EncodeRequest(root, tuple(keep)))
    rows = [(n, *[r.summary[k] for k in ("files_ready", "vectors_encoded", "cache_hits", "files_failed", "files_skipped")], r.complete, r.exit_code) for n, r in runs.items()]
    return spark.createDataFrame(rows, "name string, ready long, encoded long, hits long, failed long, skipped long, complete boolean, exit_code long")


@query(
    _values(
        "name, outcome",
        [
            ("as written", "accepted"), ("another version", "unsupported_schema_version"), ("unknown field", "invalid_vector_file"), ("changed component", "invalid_vector_file"), ("two vectors of one content", "invalid_vector_file"),
            ("unknown profile", "unknown_profile"), ("path above the root", "invalid_vector_file"), ("wrong count", "invalid_vector_file"), ("reuse of a failure", "invalid_vector_file"),
            ("key twice", "invalid_vector_file"), ("value after the end", "invalid_vector_file"), ("no number", "invalid_vector_file"), ("no text", "invalid_vector_file"), ("read back", "accepted"),
        ],
    )
)
def q40_result_file(spark: SparkSession, d: str) -> DataFrame:
    """Result files read strictly: one as written, and one for each way to spoil it."""
    with _folder(spark) as path:
        root = _tree(path)
        result = Engine(spark, _SMALL).encode(EncodeRequest(root, ("large.wav",)))
        bundle = vector_file.bundle_of(result.records, root, result.summary, result.complete)
        target = os.path.join(path, "out.json")
        vector_file.write_json(target, bundle)
        vector_file.write_json(target, bundle)
        with open(target, "rb") as f:
            data = f.read()
        again = vector_file.read_json(target)
    ready = [i for i, f in enumerate(bundle["files"]) if f["state"] == "ready"]
    copies = [i for i in ready if bundle["files"][i]["reused"]]

    def spoiled(change) -> bytes:
        copy = json.loads(data)
        change(copy)
        return json.dumps(copy).encode()

    def other_vector(b: dict) -> None:
        one, two = b["files"][copies[0]], next(b["files"][i] for i in ready if b["files"][i]["file_id"] != b["files"][copies[0]]["file_id"] and b["files"][i]["family"] == "text")
        one["vector"], one["vector_sha256"] = two["vector"], two["vector_sha256"]

    cases = {
        "as written": data,
        "another version": spoiled(lambda b: b.update(schema_version=99)),
        "unknown field": spoiled(lambda b: b.update(extra=1)),
        "changed component": spoiled(lambda b: b["files"][ready[0]]["vector"].__setitem__(0, 0.5)),
        "two vectors of one content": spoiled(other_vector),
        "unknown profile": spoiled(lambda b: b["files"][ready[0]].update(profile_id="sha256:" + "0" * 64)),
        "path above the root": spoiled(lambda b: b["files"][0].update(path="../x")),
        "wrong count": spoiled(lambda b: b["summary"].update(files_ready=1)),
        "reuse of a failure": spoiled(lambda b: b["files"].__setitem__(0, {"path": "zz", "state": "failed", "reused": True})),
        "key twice": data.replace(b'"complete":', b'"complete":true,"complete":', 1),
        "value after the end": data + b"{}",
        "no number": data.replace(b'"workers":2', b'"workers":NaN', 1),
        "no text": data.replace(b"a.txt", b"\xff.txt", 1),
        "read back": json.dumps(again).encode(),
    }

    def outcome(content: bytes) -> str:
        try:
            vector_file.parse_json(content)
        except LodestoneError as e:
            return e.code
        return "accepted"

    return spark.createDataFrame([(n, outcome(c)) for n, c in cases.items()], "name string, outcome string")


@query(
    _values(
        "name, outcome",
        [
            ("default", "accepted"), ("no workers", "invalid_request"), ("65 workers", "invalid_request"), ("no memory", "invalid_request"), ("no staging", "invalid_request"), ("no deadline", "invalid_request"),
            ("unknown backend", "invalid_request"), ("relative root", "invalid_request"), ("root is a link", "invalid_request"), ("root is absent", "io_error"), ("root excluded", "invalid_request"),
        ],
    )
)
def q41_requests(spark: SparkSession, d: str) -> DataFrame:
    """Configurations and requests that are refused at once, and with which code."""
    with _folder(spark) as path:
        os.symlink(path, os.path.join(path, "self"))
        cases = {
            "default": lambda: EngineConfig(),
            "no workers": lambda: EngineConfig(workers=0),
            "65 workers": lambda: EngineConfig(workers=65),
            "no memory": lambda: EngineConfig(memory_bytes=0),
            "no staging": lambda: EngineConfig(staging_bytes=0),
            "no deadline": lambda: EngineConfig(deadline=math.inf),
            "unknown backend": lambda: EngineConfig(backend="abacus"),
            "relative root": lambda: directory.resolve_root("some/where"),
            "root is a link": lambda: directory.resolve_root(os.path.join(path, "self")),
            "root is absent": lambda: directory.resolve_root(os.path.join(path, "absent")),
            "root excluded": lambda: directory.scan(spark, path, [path]),
        }

        def outcome(case) -> str:
            try:
                case()
            except LodestoneError as e:
                return e.code
            return "accepted"

        return spark.createDataFrame([(n, outcome(c)) for n, c in cases.items()], "name string, outcome string")


@query(
    _values(
        "code, exit_code",
        [
            ("invalid_request", 2), ("unsupported_schema_version", 2), ("unknown_profile", 2), ("invalid_vector_file", 2), ("io_error", 1), ("resource_budget_too_small", 2), ("source_changed", 1),
            ("unsupported_format", 1), ("unselected_family", 1), ("invalid_text", 1), ("insufficient_content", 1), ("runtime_unavailable", 1), ("model_integrity", 1), ("decode_failed", 1), ("worker_failed", 1),
            ("worker_timeout", 1), ("output_closed", 1), ("cancelled", 130),
        ],
    )
)
def q42_error_codes(spark: SparkSession, d: str) -> DataFrame:
    """The exit code of a run that ends with each error."""
    return spark.createDataFrame([(c, LodestoneError(c, "run", "").exit_code) for c in ERROR_CODES], "code string, exit_code long")


@query(_values("name, outcome", [("text", "plain"), ("bytes", "n\\xff"), ("wrong base64", "invalid_vector_file"), ("NUL", "invalid_vector_file"), ("number", "invalid_vector_file"), ("unknown encoding", "invalid_vector_file")]))
def q43_path_values(spark: SparkSession, d: str) -> DataFrame:
    """Paths read back from JSON: text, or bytes in base64."""
    cases = {
        "text": "plain", "bytes": vector_file.path_value(b"n\xff"), "wrong base64": {"encoding": "posix_bytes", "base64": "*"}, "NUL": {"encoding": "posix_bytes", "base64": base64.b64encode(b"a\0").decode()},
        "number": 7, "unknown encoding": {"encoding": "other", "base64": ""},
    }

    def outcome(value) -> str:
        try:
            return vector_file.path_of(value).decode("utf-8", "backslashreplace")
        except LodestoneError as e:
            return e.code

    return spark.createDataFrame([(n, outcome(v)) for n, v in cases.items()], "name string, outcome string")


def _pixels() -> np.ndarray:
    """A picture of 96 x 64 pixels from a formula."""
    y, x = np.mgrid[0:64, 0:96]
    return np.stack([(x * 3 + y * 7) % 256, (x * 11 + y * 5) % 256, x * y % 256], 2).astype(np.uint8)


def _png(rows: np.ndarray, kind: int, bits: int, filters: tuple[int, ...], extra: dict[bytes, bytes] | None = None, width: int = 96) -> bytes:
    """A PNG of rows of bytes, each under one of the filters in turn."""
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind] * bits // 8 or 1
    padded = np.pad(rows.astype(np.int64), ((1, 0), (step, 0)))
    left, up, corner = padded[1:, :-step], padded[:-1, step:], padded[:-1, :-step]
    guess = left + up - corner
    away = np.stack([abs(guess - v) for v in (left, up, corner)])
    paeth = np.choose(away.argmin(0), [left, up, corner])
    taken = [0 * left, left, up, (left + up) // 2, paeth]
    raw = b"".join(bytes([f]) + ((rows[y] - taken[f][y]) % 256).astype(np.uint8).tobytes() for y, f in ((y, filters[y % len(filters)]) for y in range(len(rows))))
    parts = {b"IHDR": struct.pack(">IIBBBBB", width, len(rows), bits, kind, 0, 0, 0), **(extra or {}), b"IDAT": zlib.compress(raw), b"IEND": b""}
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(v)) + k + v + struct.pack(">I", zlib.crc32(k + v)) for k, v in parts.items())


def _pictures() -> dict[str, bytes]:
    rgb = _pixels()
    alpha = np.concatenate([rgb, np.full((64, 96, 1), 255, np.uint8)], 2)
    wide = np.stack([alpha, 0 * alpha], 3)
    flat, bgr = rgb.reshape(64, -1), rgb[:, :, ::-1]
    grey = np.repeat(rgb[:, :, :1], 3, 2)
    table = b"".join(bytes([i, i, i]) for i in range(256))
    return {
        "png": _png(flat, 2, 8, (0, 1, 2, 3, 4)), "png with alpha": _png(alpha.reshape(64, -1), 6, 8, (4,)), "png of 16 bits": _png(np.stack([rgb, rgb], 3).reshape(64, -1), 2, 16, (1, 3)),
        "bmp": b"BM" + struct.pack("<IIIIiiHHIIIIII", 0, 0, 54, 40, 96, 64, 1, 24, 0, 0, 0, 0, 0, 0) + bgr[::-1].tobytes(), "ppm": b"P6\n# made by hand\n96 64\n255\n" + rgb.tobytes(),
        "plain ppm": b"P3 96 64 255\n" + " ".join(map(str, rgb.ravel())).encode(), "pam": b"P7\nWIDTH 96\nHEIGHT 64\nDEPTH 3\nMAXVAL 255\nTUPLTYPE RGB\nENDHDR\n" + rgb.tobytes(),
        "qoi": b"qoif" + struct.pack(">IIBB", 96, 64, 3, 0) + b"".join(b"\xfe" + bytes(p) for p in rgb.reshape(-1, 3)) + b"\0" * 7 + b"\1", "farbfeld": b"farbfeld" + struct.pack(">II", 96, 64) + wide.tobytes(),
        "grey png": _png(rgb[:, :, 0], 0, 8, (2, 4)), "palette": _png(rgb[:, :, 0], 3, 8, (0,), {b"PLTE": table}), "pgm": b"P5 96 64 255\n" + grey[:, :, 0].tobytes(),
        "clear png": _png(np.concatenate([rgb, np.zeros((64, 96, 1), np.uint8)], 2).reshape(64, -1), 6, 8, (1,)),
        "damaged png": _png(flat, 2, 8, (0,))[:-30] + b"x" * 30, "cut off ppm": b"P6 96 64 255\n" + rgb.tobytes()[:-1], "huge": b"P6 30000 30000 255\n", "jpeg": b"\xff\xd8\xff\xe0",
    }


@query(
    """WITH p AS (SELECT x, y FROM (SELECT unnest(range(0, 96)) AS x), (SELECT unnest(range(0, 64)) AS y)),
s AS (SELECT sum((x * 3 + y * 7) % 256)::BIGINT AS r, sum((x * 11 + y * 5) % 256)::BIGINT AS g, sum(x * y % 256)::BIGINT AS b FROM p)
SELECT name, format, CASE WHEN format IS NULL THEN -1 ELSE 96 END::BIGINT AS width, CASE WHEN format IS NULL THEN -1 ELSE 64 END::BIGINT AS height,
 CASE kind WHEN 'bad' THEN -1 WHEN 'black' THEN 0 ELSE r END::BIGINT AS red, CASE kind WHEN 'bad' THEN -1 WHEN 'black' THEN 0 WHEN 'grey' THEN r ELSE g END::BIGINT AS green,
 CASE kind WHEN 'bad' THEN -1 WHEN 'black' THEN 0 WHEN 'grey' THEN r ELSE b END::BIGINT AS blue, error FROM s, (VALUES ('png', 'png', 'rgb', NULL), ('png with alpha', 'png', 'rgb', NULL), ('png of 16 bits', 'png', 'rgb', NULL),
 ('bmp', 'bmp', 'rgb', NULL), ('ppm', 'pnm', 'rgb', NULL), ('plain ppm', 'pnm', 'rgb', NULL), ('pam', 'pnm', 'rgb', NULL), ('qoi', 'qoi', 'rgb', NULL), ('farbfeld', 'farbfeld', 'rgb', NULL), ('grey png', 'png', 'grey', NULL),
 ('palette', 'png', 'grey', NULL), ('pgm', 'pnm', 'grey', NULL), ('clear png', 'png', 'black', NULL), ('damaged png', NULL, 'bad', 'decode_failed'), ('cut off ppm', NULL, 'bad', 'decode_failed'),
 ('huge', NULL, 'bad', 'resource_budget_too_small'), ('jpeg', NULL, 'bad', 'runtime_unavailable')) v(name, format, kind, error)"""
)
def q44_raster_pixels(spark: SparkSession, d: str) -> DataFrame:
    """One picture in every format that can be read, and images that cannot."""
    rows = spark.createDataFrame([(n, bytearray(c)) for n, c in _pictures().items()], "name string, content binary")
    return rows.select("name", raster_outcomes("content").alias("o")).select("name", "o.*")
