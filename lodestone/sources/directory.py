"""A directory tree as a DataFrame: a Python data source that never follows links.

The driver lists names and kinds only; executors open, hash and stat the files, so the
tree must be on a file system they share. Hidden files count, names need not be UTF-8.
"""

from __future__ import annotations

import base64
import errno
import hashlib
import json
import os
import stat
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.types import LodestoneError

NAME = "lodestone_directory"
SCHEMA = (
    "path_bytes binary, path string, kind string, device long, inode long, bytes long, mtime long, mtime_ns long, "
    "ctime long, ctime_ns long, file_id string, prefix binary, error_code string, error_stage string, error_message string"
)
OPEN = os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK | os.O_CLOEXEC
PREFIX, CHUNK = 512, 1 << 16
FILES_PER_TASK = 2000


def resolve_root(root: str | bytes) -> bytes:
    """An absolute directory whose parent is made canonical; the root itself is no link."""
    raw = os.fsencode(root)
    if not raw.startswith(b"/"):
        raise LodestoneError("invalid_request", "discovery", "the directory must be an absolute path")
    raw = raw.rstrip(b"/") or b"/"
    if raw == b"/":
        return raw
    try:
        full = os.path.join(os.path.realpath(os.path.dirname(raw), strict=True), os.path.basename(raw))
        if not stat.S_ISDIR(os.lstat(full).st_mode):
            raise LodestoneError("invalid_request", "discovery", "the root is no directory, or a link")
    except OSError as e:
        raise LodestoneError("io_error", "discovery", str(e)) from None
    return full


def open_secure(root: bytes, parts: list[bytes]) -> int:
    """Descriptor of a path below root, every component opened without following links."""
    at = os.open(root, OPEN | os.O_DIRECTORY)
    try:
        for i, part in enumerate(parts):
            step = os.open(part, OPEN | (os.O_DIRECTORY if i + 1 < len(parts) else 0), dir_fd=at)
            os.close(at)
            at = step
        return at
    except BaseException:
        os.close(at)
        raise


def revision(st: os.stat_result) -> tuple[int, ...]:
    """What must stay the same while a file is read: device, inode, size and times. (Python
    has no birth time of files here; an inode used again shows in its change time.)"""
    return (st.st_dev, st.st_ino, st.st_size, st.st_mtime_ns // 10**9, st.st_mtime_ns % 10**9, st.st_ctime_ns // 10**9, st.st_ctime_ns % 10**9)


def _still_there(root: bytes, path: bytes, st: os.stat_result) -> bool:
    """Whether the path, looked up again, leads to the file that was read."""
    try:
        fd = open_secure(root, path.split(b"/"))
    except OSError:
        return False
    try:
        return revision(os.fstat(fd)) == revision(st)
    finally:
        os.close(fd)


def walk(root: bytes, exclude: list[bytes]) -> Iterator[tuple[bytes, str, str | None]]:
    """(relative path, kind, error) of everything below root, with an own stack.

    kind is file, other (a link, device, pipe or socket) or directory (only with an error:
    unreadable, or reached before). Excluded paths and all below them are left out.
    """
    skip = {tuple(e.split(b"/")) for e in exclude}
    seen: set[tuple[int, int]] = set()
    stack: list[list[bytes]] = [[]]
    while stack:
        parts = stack.pop()
        try:
            fd = open_secure(root, parts)
        except OSError as e:
            if not parts:
                raise LodestoneError("io_error", "discovery", str(e)) from None
            yield b"/".join(parts), "directory", str(e)
            continue
        try:
            st = os.fstat(fd)
            if (st.st_dev, st.st_ino) in seen:
                yield b"/".join(parts), "directory", "the directory was reached before"
                continue
            seen.add((st.st_dev, st.st_ino))
            for name in sorted(os.fsencode(n) for n in os.listdir(fd)):
                child = [*parts, name]
                if tuple(child) in skip:
                    continue
                try:
                    mode = os.stat(name, dir_fd=fd, follow_symlinks=False).st_mode
                except OSError as e:
                    yield b"/".join(child), "file", str(e)
                    continue
                if stat.S_ISDIR(mode):
                    stack.append(child)
                else:
                    yield b"/".join(child), "file" if stat.S_ISREG(mode) else "other", None
        finally:
            os.close(fd)


def _text(path: bytes) -> str | None:
    try:
        return path.decode()
    except UnicodeDecodeError:
        return None


def read_file(root: bytes, path: bytes) -> tuple:
    """The row of one regular file: revision, digest of all bytes and the first 512."""
    base = (path, _text(path), "file")
    try:
        fd = open_secure(root, path.split(b"/"))
    except OSError as e:
        changed = e.errno in (errno.ELOOP, errno.ENOTDIR, errno.ENOENT)
        return (*base, *[None] * 9, "source_changed" if changed else "io_error", "hashing", str(e))
    try:
        before = revision(os.fstat(fd))
        if not stat.S_ISREG(os.fstat(fd).st_mode):
            return (*base, *[None] * 9, "source_changed", "hashing", "no regular file any more")
        digest, prefix = hashlib.sha256(), b""
        while block := os.read(fd, CHUNK):
            prefix = prefix or block[:PREFIX]
            digest.update(block)
        after = os.fstat(fd)
        if revision(after) != before or not _still_there(root, path, after):
            return (*base, *before, None, None, "source_changed", "hashing", "the file changed while it was read")
        return (*base, *before, "sha256:" + digest.hexdigest(), prefix, None, None, None)
    except OSError as e:
        return (*base, *[None] * 9, "io_error", "hashing", str(e))
    finally:
        os.close(fd)


def read_again(root: bytes, path: bytes, expected: tuple, most: int) -> tuple[bytes | None, str | None]:
    """(content, error code) of a file that must be as it was when it was hashed."""
    try:
        fd = open_secure(root, path.split(b"/"))
    except OSError as e:
        return None, "source_changed" if e.errno in (errno.ELOOP, errno.ENOTDIR, errno.ENOENT) else "io_error"
    try:
        if revision(os.fstat(fd)) != expected:
            return None, "source_changed"
        if expected[2] > most:
            return None, "resource_budget_too_small"
        blocks = []
        while block := os.read(fd, 1 << 20):
            blocks.append(block)
        after = os.fstat(fd)
        same = revision(after) == expected and _still_there(root, path, after)
        return (b"".join(blocks), None) if same else (None, "source_changed")
    except OSError:
        return None, "io_error"
    finally:
        os.close(fd)


class _Entries(InputPartition):
    def __init__(self, entries: list[tuple[bytes, str, str | None]]):
        super().__init__(0)
        self.entries = entries


class DirectoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = resolve_root(base64.b64decode(options["root64"]) if "root64" in options else options.get("path", ""))
        self.exclude = [base64.b64decode(x) for x in json.loads(options.get("exclude64", "[]"))]

    def partitions(self) -> list[InputPartition]:
        found = sorted(walk(self.root, self.exclude), key=lambda e: e[0].split(b"/"))
        return [_Entries(found[i : i + FILES_PER_TASK]) for i in range(0, len(found), FILES_PER_TASK)] or [_Entries([])]

    def read(self, partition: _Entries) -> Iterator[tuple]:
        for path, kind, error in partition.entries:
            if kind == "file" and error is None:
                yield read_file(self.root, path)
            elif kind == "other":
                yield (path, _text(path), kind, *[None] * 9, "unsupported_format", "discovery", "no regular file")
            else:
                yield (path, _text(path), kind, *[None] * 9, "io_error", "discovery", error)


class DirectorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DirectoryReader:
        return DirectoryReader(self.options)


def scan(spark: SparkSession, root: str | bytes, exclude: list[str | bytes] = ()):
    """Rows of SCHEMA for everything below root. exclude: absolute paths, or relative ones."""
    base = resolve_root(root)
    inside = []
    for e in map(os.fsencode, exclude):
        e = e.rstrip(b"/")
        if e.startswith(b"/"):
            if e == base:
                raise LodestoneError("invalid_request", "discovery", "the root is excluded")
            if not e.startswith(base.rstrip(b"/") + b"/"):
                continue
            e = e[len(base.rstrip(b"/")) + 1 :]
        inside.append(base64.b64encode(e).decode())
    spark.dataSource.register(DirectorySource)
    return spark.read.format(NAME).option("root64", base64.b64encode(base).decode()).option("exclude64", json.dumps(inside)).load()
