"""Encoding a directory: scan, classify, reuse, encode each content once, publish rows."""

from __future__ import annotations

import hashlib
import json
import signal
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.audio import encode_sound
from lodestone.functions.docx import docx_text
from lodestone.functions.identity import path_order, sniff
from lodestone.functions.text import TextFailure, decode, encode_text, gram_counts, unit, WHITE_SPACE
from lodestone.functions.vectors import vector_bytes
from lodestone.operators.counters import run_counters
from lodestone.profiles import active_profiles
from lodestone.session import materialize
from lodestone.sources.directory import read_again, resolve_root, scan
from lodestone.types import NORM_TOLERANCE, RECORD, LodestoneError


@dataclass(frozen=True)
class EngineConfig:
    """Limits and choices of an engine; invalid values raise at once."""

    backend: str = "cpu"
    workers: int = 2
    memory_bytes: int = 2 << 30
    staging_bytes: int = 10 << 30
    batches: int = 1
    #: Seconds a reader may take for one file.
    deadline: float = 300.0

    def __post_init__(self):
        if not 1 <= self.workers <= 64 or self.memory_bytes <= 0 or self.staging_bytes <= 0 or self.batches < 1 or not 0 < self.deadline < float("inf"):
            raise LodestoneError("invalid_request", "request", "workers, memory, staging, batches or deadline out of range")
        active_profiles(self.backend)


@dataclass(frozen=True)
class EncodeRequest:
    directory: str
    exclude: tuple[str, ...] = ()


class CancellationToken:
    def __init__(self):
        self._event = threading.Event()

    def cancel(self) -> None:
        self._event.set()

    @property
    def is_cancelled(self) -> bool:
        return self._event.is_set()


@dataclass
class RunResult:
    records: DataFrame
    summary: dict
    complete: bool
    directory: str
    progress: list[dict] = field(default_factory=list)

    @property
    def exit_code(self) -> int:
        s = self.summary
        if s["cancelled"]:
            return 130
        return 3 if not self.complete or s["files_failed"] or s["files_skipped"] else 0


#: Memory that a worker must have for readers of each family; plain text is read by any.
LEAST_MEMORY = {"text": 128 << 20, "audio": 128 << 20, "image": 512 << 20, "video": 512 << 20}
#: Seconds between two events of progress inside a stage.
CADENCE = 0.25

#: A reader takes the bytes of a file and gives (unit vector, extraction); it raises
#: TextFailure with an error code for content that it can't use.
Reader = Callable[[bytes], tuple]


def _utf8(content: bytes) -> tuple:
    vector, characters = encode_text(content)
    return vector, {"coverage": "complete_source_text", "characters": characters}


def _docx(content: bytes) -> tuple:
    text = decode(docx_text(content).encode())
    if all(ord(c) in WHITE_SPACE for c in text):
        raise TextFailure("insufficient_content", "no characters but white space")
    return unit(gram_counts(text)), {"coverage": "complete_main_document_body", "reader": "docx", "characters": len(text), "utf8_bytes": len(text.encode())}


def _missing(what: str) -> Reader:
    def read(content: bytes) -> tuple:
        raise TextFailure("runtime_unavailable", f"no reader for {what} is installed")

    return read


def default_readers() -> dict[tuple[str, str], Reader]:
    """Readers by family and format; users replace or add entries to extend the engine."""
    out = {("text", "utf8"): _utf8, ("text", "docx"): _docx, ("audio", "media"): encode_sound}
    return out | {k: _missing("/".join(k)) for k in (("text", "pdf"), ("image", "raster"), ("image", "tga"), ("image", "heif_avif"), ("video", "media"))}


#: What reading one path gave. `shared`: it is of the content and holds for its copies; else
#: of this path alone, whose file could not be read as it was.
OUTCOME = "path_bytes binary, file_id string, family string, format string, vector array<float>, vector_sha256 string, extraction string, error_code string, error_stage string, error_message string, shared boolean"


class _Deadline(Exception):
    pass


@contextmanager
def within(seconds: float) -> Iterator[None]:
    """Raise _Deadline in what runs longer, where signals can be had (main threads)."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_):
        raise _Deadline

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def checked(vector, dimensions: int) -> np.ndarray:
    """A reader's vector as float32, if it has the dimensions, finite values and unit norm."""
    try:
        out = np.asarray(vector, np.float32)
    except (TypeError, ValueError):
        raise TextFailure("worker_failed", "the reader gave no vector") from None
    if out.shape != (dimensions,):
        raise TextFailure("worker_failed", f"the reader gave {out.shape}, not {dimensions} components")
    wide = out.astype(np.float64)
    if not np.isfinite(out).all() or abs(float((wide * wide).sum()) - 1) > NORM_TOLERANCE:
        raise TextFailure("worker_failed", "the reader's vector is not of unit length")
    return out


class Engine:
    """Encodes directories on a session; readers decide what can be decoded."""

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, readers: dict[tuple[str, str], Reader] | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        self.readers = readers or default_readers()
        self.profiles = active_profiles(self.config.backend)

    def encode(self, request: EncodeRequest, saved: DataFrame | None = None, cancel: CancellationToken | None = None, progress: Callable[[dict], None] | None = None) -> RunResult:
        """Records of everything in a directory; failures of files are rows, not exceptions.

        saved: records of earlier runs; ready ones whose content and profile agree are
        taken over and not decoded again. Each other content is encoded once, at its least
        path; its copies are reused. Files are encoded in `batches` ranges of paths; a
        cancelled run keeps its finished ranges.
        """
        began = time.monotonic()
        cancel = cancel or CancellationToken()
        root = resolve_root(request.directory)
        told: list[dict] = []

        def tell(stage: str, **counts) -> None:
            told.append({"stage": stage, "elapsed_seconds": time.monotonic() - began} | counts)
            if progress:
                progress(told[-1])

        tell("discovering", files_total=None)
        found = materialize(self._classified(scan(self.spark, root, list(request.exclude))))
        total = found.count()
        tell("encoding", files_total=total, files_processed=0)
        parts: list[DataFrame] = []
        bounds = found.select(F.lit(1).alias("part"), "path_bytes")
        if self.config.batches > 1:
            ranged = found.select(path_order(F.decode("path_bytes", "ISO-8859-1")).alias("o"), "path_bytes").repartitionByRange(self.config.batches, "o")
            bounds = materialize(ranged.select((F.spark_partition_id() + 1).alias("part"), "path_bytes"))
        known = saved
        done, stopped = 0, False
        for part in range(1, self.config.batches + 1):
            rows = found.join(bounds.where(F.col("part") == part).select("path_bytes"), "path_bytes")
            beat = lambda: tell("encoding", files_total=total, files_processed=done)  # noqa: E731, B023
            made = None if cancel.is_cancelled else self._unless(cancel, lambda: materialize(self._encode(rows, known, root)), beat)  # noqa: B023
            if made is None:
                stopped = True
                break
            parts.append(made)
            known = made if known is None else known.select(*made.columns).unionByName(made)
            done += made.count()
            tell("encoding", files_total=total, files_processed=done)
        records = self.spark.createDataFrame([], RECORD) if not parts else parts[0]
        for p in parts[1:]:
            records = records.unionByName(p)
        counts = run_counters(records).collect()[0].asDict()
        cancelled = stopped
        complete = not cancelled and done == total and not found.where("kind = 'directory'").limit(1).count()
        read = found.agg(F.coalesce(F.sum(F.least(F.col("bytes"), F.lit(512))), F.lit(0))).collect()[0][0]
        summary = counts | {"files_discovered": total, "files_total": total, "elapsed_seconds": time.monotonic() - began, "backend": self.config.backend, "workers": self.config.workers, "cancelled": cancelled, "bytes_read": counts["bytes_hashed"] + read}
        tell("cancelled" if cancelled else "completed", **counts)
        return RunResult(records.orderBy(path_order(F.decode("path_bytes", "ISO-8859-1"))), summary, complete, root.decode(errors="surrogateescape"), told)

    def _unless(self, cancel: CancellationToken, work: Callable[[], DataFrame], beat: Callable[[], None]) -> DataFrame | None:
        """The result of `work`, or None if the run was cancelled meanwhile: then its jobs,
        which carry a tag of this call, are interrupted. `beat` is called every CADENCE
        seconds until then."""
        tag, over = "lodestone-" + uuid.uuid4().hex, threading.Event()

        def watch() -> None:
            while not over.wait(CADENCE):
                if cancel.is_cancelled:
                    context.cancelJobsWithTag(tag)
                beat()

        context = self.spark.sparkContext
        context.addJobTag(tag)
        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            return work()
        except Exception:
            if cancel.is_cancelled:
                return None
            raise
        finally:
            over.set()
            watcher.join()
            context.removeJobTag(tag)

    def _classified(self, scanned: DataFrame) -> DataFrame:
        ids = self.spark.createDataFrame([(f, p.profile_id) for f, p in self.profiles.items()], "family string, profile_id string")
        kind = sniff(F.col("prefix"), F.col("path"))
        rows = scanned.withColumn("_kind", F.when(F.col("file_id").isNotNull(), kind)).withColumns({"family": F.col("_kind.family"), "format": F.col("_kind.format")}).drop("_kind", "prefix")
        return rows.join(F.broadcast(ids), "family", "left")

    def _encode(self, rows: DataFrame, saved: DataFrame | None, root: bytes) -> DataFrame:
        order = path_order(F.decode("path_bytes", "ISO-8859-1"))
        usable = F.col("error_code").isNull() & F.col("profile_id").isNotNull()
        if saved is None:
            saved = self.spark.createDataFrame([], RECORD)
        cache = saved.where("state = 'ready'").groupBy("file_id", "profile_id").agg(F.min(F.struct("vector_sha256", "vector", "extraction")).alias("hit"))
        joined = rows.join(cache, ["file_id", "profile_id"], "left")
        misses = joined.where(usable & F.col("hit").isNull())
        # Paths of one content lie together and in order: the first that can be read gives
        # its outcome, those after it are passed over. Rows are names, not contents.
        key = ["file_id", "family", "format"]
        queue = misses.select("path_bytes", *key, "device", "inode", "bytes", "mtime", "mtime_ns", "ctime", "ctime_ns", order.alias("o"))
        queue = queue.repartition(max(1, self.spark.sparkContext.defaultParallelism), *key).sortWithinPartitions(*key, "o").drop("o")
        made = materialize(queue.mapInPandas(self._reader(root), OUTCOME))
        got_ = F.struct("vector", "vector_sha256", "extraction", "error_code", "error_stage", "error_message").alias("got")
        shared = made.where("shared").select(*key, F.col("path_bytes").alias("by"), got_)
        alone = made.where("NOT shared").select("path_bytes", F.struct("error_code", "error_stage", "error_message").alias("own"))
        out = joined.join(shared, key, "left").join(alone, "path_bytes", "left")
        hit, got, own = F.col("hit"), F.col("got"), F.col("own")
        ready = hit.isNotNull() | (own.isNull() & got["vector"].isNotNull())
        code = F.coalesce(F.col("error_code"), own["error_code"], F.when(~ready, got["error_code"]), F.when(~ready & F.col("file_id").isNotNull(), F.lit("unsupported_format")))
        lost = F.coalesce(own["error_code"] == "source_changed", F.lit(False))
        stage = F.coalesce(F.col("error_stage"), own["error_stage"], got["error_stage"], F.lit("encoding"))
        message = F.coalesce(F.col("error_message"), own["error_message"], got["error_message"], F.lit("no reader for this format"))
        error = F.struct(code.alias("code"), stage.alias("stage"), message.alias("message"), F.lit(None).cast("string").alias("details"))
        state = F.when(ready, "ready").when(F.col("kind") == "other", "skipped").when(code == "unsupported_format", "unsupported").otherwise("failed")
        return out.select(
            "path_bytes", "path", F.when(~lost, F.col("file_id")).alias("file_id"), "bytes", state.alias("state"),
            F.when(F.col("family") != "unknown", F.col("family")).alias("family"), F.when(ready, F.col("profile_id")).alias("profile_id"),
            F.when(ready, F.coalesce(hit["vector"], got["vector"])).alias("vector"), F.when(ready, F.coalesce(hit["vector_sha256"], got["vector_sha256"])).alias("vector_sha256"),
            (ready & (hit.isNotNull() | (F.col("by") != F.col("path_bytes")))).alias("reused"), F.when(~ready, error).alias("error"),
            F.when(ready, F.coalesce(hit["extraction"], got["extraction"])).alias("extraction"),
        )

    def _reader(self, root: bytes):
        readers, deadline, staging = self.readers, self.config.deadline, self.config.staging_bytes
        memory = self.config.memory_bytes // self.config.workers
        dimensions = {f: p.dimensions for f, p in self.profiles.items()}

        def outcome(content: bytes, family: str, form: str) -> tuple:
            """(vector, digest, extraction, error code, message) of one content."""
            reader = readers.get((family, form))
            if reader is None:
                return None, None, None, "unsupported_format", f"no reader for {family}/{form}"
            try:
                with within(deadline):
                    vector, extraction = reader(content)
                vector = checked(vector, dimensions[family])
                return vector, hashlib.sha256(vector_bytes(vector)).hexdigest(), json.dumps(extraction), None, None
            except TextFailure as e:
                return None, None, None, e.code, e.message
            except _Deadline:
                return None, None, None, "worker_timeout", f"the reader took more than {deadline:g} s"
            except Exception as e:  # a reader that breaks loses its file, not the run
                return None, None, None, "worker_failed", f"{type(e).__name__}: {e}"[:500]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = None
            for frame in frames:
                out = []
                for r in frame.itertuples(index=False):
                    path, key = bytes(r.path_bytes), (r.file_id, r.family, r.format)
                    if key == known:
                        continue
                    content, code = read_again(root, path, tuple(int(x) for x in r[4:]), memory if r.format == "utf8" else staging)
                    if code:
                        out.append((path, *key, None, None, None, code, "staging", code, False))
                        continue
                    if r.format != "utf8" and memory < LEAST_MEMORY[r.family]:
                        out.append((path, *key, None, None, None, "resource_budget_too_small", "runtime", "a worker has too little memory for this reader", True))
                        known = key
                        continue
                    vector, digest, extraction, code, message = outcome(content, r.family, r.format)
                    out.append((path, *key, vector, digest, extraction, code, "encoding" if code else None, message, True))
                    known = key
                    if len(out) >= 64:  # vectors of some 16 KB each
                        yield pd.DataFrame(out, columns=NAMES)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=NAMES)

        return run


NAMES = [c.split()[0] for c in OUTCOME.split(", ")]
