"""Session helpers: a configured local session, shared scratch space, lineage cuts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and local runs; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestone")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per session.

    Local workers get its folder on their path; a cluster gets the package as a zip file,
    unless the workers' environment names the folder already.
    """
    sc = spark.sparkContext
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if home in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_lodestone_shipped", False):
        return
    if sc.master.startswith("local["):
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [home, sc.environment.get("PYTHONPATH", "")]))
    else:
        base = os.path.join(tempfile.mkdtemp(), "lodestone")
        sc.addPyFile(shutil.make_archive(base, "zip", home, "lodestone"))
    sc._lodestone_shipped = True


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where that setting is absent (local tests) a fresh folder of this machine is
    used, and removed when this program ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = getattr(spark, "_lodestone_scratch", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        shared = "file://" + own
        spark._lodestone_scratch = shared
    return shared


def materialize(df: DataFrame, rows_of_file: int = 0) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back; in files of so many
    rows at most, if a number is given.

    Cuts the lineage as checkpoint() does and survives the loss of executors, but keeps
    columns prunable, compressed and measured. The folder stays until discard() or until
    the checkpoint folder ends.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), f"lodestone-{uuid.uuid4().hex}")
    df.write.option("maxRecordsPerFile", rows_of_file).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a folder, wherever it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def discard(*tables: DataFrame) -> None:
    """Remove the folders of materialized tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_lodestone_path", None)
        if path:
            fs, where = file_system(df.sparkSession, path)
            fs.delete(where, True)


#: Rows of an Arrow batch where rows hold whole vectors: 10,000 of them, the default, are 160 MB.
VECTOR_ROWS = "400"


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches, and shuffle files removed when the job that made them has ended.

    For operators that write their stages with materialize(): nothing reads a stage's
    shuffle files after it. The settings of the session are put back at the end.
    """
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": VECTOR_ROWS, "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
