"""Processing only new or changed records: the target is the state.

Every output row of the target carries the source key and the version it was made from.
A run anti-joins the source with the target on both, takes what is left, and publishes the
grown target as a new version by one atomic rename; a run that dies before that rename
publishes nothing, so nothing is lost or repeated after a failure.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import file_system

#: A delivery equal to an earlier one in these columns is the same observation again.
VERSION = ("inode", "mtime", "mtime_ns", "ctime", "ctime_ns", "file_id")
KEY = ("root", "path")
#: Succeeded runs that one call goes through, at most.
MAX_RUNS = 50_000


def version_hash(columns: tuple[str, ...] = KEY + VERSION) -> Column:
    """A null-safe digest of key and version, 16 bytes: equal rows and only those agree."""
    return F.unhex(F.md5(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"})))


def starts_of(runs: DataFrame) -> list[tuple]:
    """(started_at, run_no) of the succeeded runs in order; of equal times the least number."""
    done = runs.where("status = 'succeeded' AND started_at IS NOT NULL").groupBy("started_at").agg(F.min("run_no").alias("run_no"))
    rows = [(r[0], int(r[1])) for r in done.orderBy("started_at").limit(MAX_RUNS + 1).collect()]
    if len(rows) > MAX_RUNS:
        raise ValueError(f"more than {MAX_RUNS} runs; pass only runs since the last published one")
    return rows


def with_run(rows: DataFrame, starts: list[tuple]) -> DataFrame:
    """Rows with run_no, of the first of `starts` at or after received_at; others are left out.

    starts: (started_at, run_no) in order, MAX_RUNS at most. Each row finds its run by a
    binary search over them.
    """
    if len(starts) > MAX_RUNS:
        raise ValueError(f"{len(starts)} runs exceed the bound of {MAX_RUNS}")
    if len(starts) == 1:
        return rows.where(F.col("received_at") <= F.lit(starts[0][0])).withColumn("run_no", F.lit(starts[0][1]).cast("long"))
    number = np.array([n for _, n in starts], np.int64)
    zone = pa.timestamp("us", "UTC")
    ends = np.array([s.astimezone(timezone.utc).replace(tzinfo=None) for s, _ in starts], "datetime64[us]").astype(np.int64)
    at = rows.columns.index("received_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            received = batch.column(at).cast(zone).cast(pa.int64()).to_numpy(zero_copy_only=False)
            place = np.searchsorted(ends, received)
            kept = batch.filter(pa.array(place < len(ends)))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(number[place[place < len(ends)]])], names=[*batch.schema.names, "run_no"])

    known = rows.where("received_at IS NOT NULL")
    return known.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("run_no", T.LongType())]))


def _fresh(source: DataFrame) -> DataFrame:
    """The first delivery of each version, as rows of STATE without `taken` and `run_no`."""
    return (
        source.where("file_id IS NOT NULL AND received_at IS NOT NULL")
        .select("rev_id", *KEY, *VERSION, "received_at")
        .withColumn("version_key", version_hash())
        .groupBy("version_key")
        .agg(F.min(F.struct("received_at", "rev_id", *KEY, "file_id")).alias("r"))
        .select("version_key", "r.*")
    )


def _new_versions(source: DataFrame, target: DataFrame | None) -> DataFrame:
    """Rows of _fresh that the target lacks (anti-join on key and version), with `changed`:
    whether the latest earlier counted row of the key has other content or is none.

    Of the target only the keys that came with fresh rows are looked at.
    """
    fresh = _fresh(source).withColumn("known", F.lit(False))
    if target is not None:
        state = target.select("version_key", "received_at", "rev_id", *KEY, "file_id")
        fresh = fresh.join(state.select("version_key").hint("merge"), "version_key", "left_anti")
        same = [F.col(f"s.{c}").eqNullSafe(F.col(f"k.{c}")) for c in KEY]
        keys = fresh.select(*KEY).distinct().alias("k")
        known = state.alias("s").join(keys.hint("merge"), same[0] & same[1], "left_semi")
        fresh = fresh.unionByName(known.withColumn("known", F.lit(True)))
    order = Window.partitionBy(*KEY).orderBy("received_at", "rev_id")
    before = fresh.withColumn("before", F.lag("file_id").over(order))
    return before.where(~F.col("known")).withColumn("changed", F.col("before").isNull() | (F.col("before") != F.col("file_id"))).drop("known", "before")


def take_new(source: DataFrame, runs: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """Rows of `source` that add or change content, with the succeeded run that takes them.

    source: KEY, VERSION, rev_id, received_at (more columns are ignored). runs: run_no,
    started_at, status. target: rows of earlier results with `version_key`, KEY, file_id,
    received_at, rev_id; its rows are never taken again and are the state that a later
    delivery is compared with.

    Order is received_at, then rev_id. Null file_id never counts. Of rows with one version
    the first counts, whether it came in this call or is already in the target. A row is
    taken if its key has no earlier counted row or the latest earlier one has another
    file_id. Null in path, inode or times is a value like any other. Null received_at is
    never taken. Empty inputs give an empty result. Repeated run rows count once.
    """
    new = with_run(_new_versions(source, target).where("changed"), starts_of(runs))
    return new.select("run_no", "rev_id", *KEY, "file_id", "received_at", "version_key")


class Conflict(Exception):
    """Another run has published since this one read the target; it may be run again."""


class IncrementalTarget:
    """A target table of immutable parts and a log of published versions, on the file
    system of its path, which all executors share.

    `root/part-<id>/` holds what a version added; `root/log/<n>.json` publishes version n
    with its part and its run. A log entry is written aside and renamed to a name that must
    not exist yet: a reader sees a run whole or not at all, of two runs that start from one
    version one publishes and the other gets Conflict, and a run that dies before leaves
    only an unreferenced part that vacuum() removes.
    """

    STATE = "version_key binary, received_at timestamp, rev_id long, root string, path string, file_id string, taken boolean, run_no long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._fs, where = file_system(spark, f"{root}/log")
        self._fs.mkdirs(where)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[dict]:
        """The published log entries in order."""
        names = sorted(int(f.getPath().getName().removesuffix(".json")) for f in self._fs.listStatus(self._path("log")) if f.getPath().getName().removesuffix(".json").isdigit())
        utils = self.spark._jvm.org.apache.commons.io.IOUtils
        out = []
        for n in names:
            stream = self._fs.open(self._path(f"log/{n}.json"))
            try:
                out.append(json.loads(utils.toString(stream, "UTF-8")))
            finally:
                stream.close()
        return out

    def _publish(self, number: int, entry: dict) -> None:
        aside, name = self._path(f"log/.{uuid.uuid4().hex}"), self._path(f"log/{number}.json")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark._sc._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            context.rename(aside, name, how)
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise Conflict(f"version {number} was published by another run") from None
            raise

    def read(self) -> DataFrame | None:
        """The published rows; None before the first published run."""
        return self._rows(self.versions())

    def _rows(self, log: list[dict]) -> DataFrame | None:
        parts = [f"{self.root}/{e['part']}" for e in log]
        return self.spark.read.schema(self.STATE).parquet(*parts) if parts else None

    def run(self, run_no: int, started_at, source: DataFrame, fail: Exception | None = None) -> int:
        """Take what arrived up to `started_at` and is new, and publish it; the rows taken.

        A run number that was published before is a no-op, so a retry repeats nothing.
        Only deliveries since the last published run are read: what came before it is in
        the target. `fail` stops the run after its rows are written, before they are
        published.
        """
        log = self.versions()
        if any(e["run"] == run_no for e in log):
            return 0
        arrived = source.where(F.col("received_at") <= F.lit(started_at))
        if log:
            arrived = arrived.where(F.col("received_at") > F.lit(datetime.fromisoformat(log[-1]["until"])))
        out = _new_versions(arrived, self._rows(log)).withColumnRenamed("changed", "taken").withColumn("run_no", F.lit(run_no).cast("long"))
        part = f"part-{uuid.uuid4().hex}"
        seen = Observation()
        out.select("version_key", "received_at", "rev_id", *KEY, "file_id", "taken", "run_no").observe(seen, F.count_if("taken").alias("taken")).write.parquet(f"{self.root}/{part}")
        if fail is not None:
            raise fail
        self._publish(len(log) + 1, {"part": part, "run": run_no, "until": started_at.astimezone(timezone.utc).isoformat()})
        return int(seen.get["taken"])

    def vacuum(self) -> list[str]:
        """Remove the parts of runs that never published; their names. No run may be on."""
        keep = {e["part"] for e in self.versions()}
        gone = sorted(n for f in self._fs.listStatus(self._path("")) if (n := f.getPath().getName()).startswith("part-") and n not in keep)
        for name in gone:
            self._fs.delete(self._path(name), True)
        return gone


def replay(source: DataFrame, runs: DataFrame, target: IncrementalTarget) -> DataFrame:
    """The rows of take_new, from every run of the log carried out against `target`.

    Runs that did not succeed publish nothing, so what arrived before them is taken by the
    next one that does. `runs` is a bounded registry (MAX_RUNS).
    """
    for started_at, run_no in starts_of(runs):
        target.run(run_no, started_at, source)
    state = target.read()
    if state is None:
        state = source.sparkSession.createDataFrame([], target.STATE)
    return state.where("taken").select("run_no", "rev_id", *KEY, "file_id", "received_at", "version_key")
