"""Queries of the general data-processing problems, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.incremental import IncrementalTarget, replay, take_new
from lodestone.operators.nested import COLLECTIONS, flatten, write_tables
from lodestone.operators.snapshots import snapshot_changes
from lodestone.session import lean, scratch_dir, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every succeeded run carried out against a target in the shared folder."""
    target = IncrementalTarget(spark, f"{scratch_dir(spark)}/lodestone-target-{uuid.uuid4().hex}")
    with lean(spark):
        taken = replay(table(spark, sf_dir, "revision"), table(spark, sf_dir, "run_log"), target)
    return taken.select(F.col("run_no").cast("long"), F.col("rev_id").cast("long"))


def p1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each succeeded run takes, and how many paths they belong to: all runs in
    one pass over an empty target."""
    taken = take_new(table(spark, sf_dir, "revision"), table(spark, sf_dir, "run_log"))
    return taken.groupBy(F.col("run_no").cast("long").alias("run_no")).agg(F.count("*").alias("taken"), F.countDistinct("root", "path").alias("paths"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten(table(spark, sf_dir, "raw_record")).select("raw_id", "parent_key", "child_key")


def p5_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each child table, as written partitioned by tag, and of its links to records
    and to parent rows."""
    path = f"{scratch_dir(spark)}/lodestone-tables-{uuid.uuid4().hex}"
    write_tables(flatten(table(spark, sf_dir, "raw_record")), path)
    written = spark.read.parquet(path)
    return written.groupBy("tag").agg(F.count("*").alias("n_rows"), F.count_if(F.col("parent_key") == "record").alias("of_records"), F.max("position").alias("max_position"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "snapshot_record"), table(spark, sf_dir, "vector_file"))


def p6_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each kind per root and snapshot."""
    changes = snapshot_changes(table(spark, sf_dir, "snapshot_record"), table(spark, sf_dir, "vector_file"))
    return changes.groupBy("root", "snapshot_no", "change").agg(F.count("*").alias("paths"))


_P1 = """
WITH counted AS (
  SELECT *, row_number() OVER (PARTITION BY root, path, inode, mtime, mtime_ns, ctime, ctime_ns, file_id ORDER BY received_at, rev_id) AS nth
  FROM revision WHERE file_id IS NOT NULL),
changed AS (
  SELECT *, lag(file_id) OVER (PARTITION BY root, path ORDER BY received_at, rev_id) AS before FROM counted WHERE nth = 1),
cases AS (
  SELECT rev_id, root, path, (SELECT min(r.started_at) FROM run_log r WHERE r.status = 'succeeded' AND r.started_at >= c.received_at) AS started_at
  FROM changed c WHERE before IS NULL OR before <> file_id),
taken AS (
  SELECT r.run_no::BIGINT AS run_no, c.rev_id::BIGINT AS rev_id, c.root, c.path
  FROM cases c JOIN run_log r ON r.started_at = c.started_at AND r.status = 'succeeded')
"""
_P6 = """
WITH heads AS (
  SELECT root, snapshot_no, row_number() OVER (PARTITION BY root ORDER BY snapshot_no) AS idx
  FROM (SELECT root, snapshot_no FROM vector_file GROUP BY ALL HAVING bool_or(complete))),
rows_ AS (
  SELECT s.root, s.path, h.idx, s.file_id, s.state,
         row_number() OVER (PARTITION BY s.root, s.snapshot_no, s.path ORDER BY s.delivered_at DESC) AS nth
  FROM snapshot_record s JOIN heads h USING (root, snapshot_no)),
last_ AS (SELECT * FROM rows_ WHERE nth = 1),
pairs AS (
  SELECT coalesce(n.root, o.root) AS root, coalesce(n.idx, o.idx + 1) AS idx, coalesce(n.path, o.path) AS path,
         CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
              WHEN n.file_id IS DISTINCT FROM o.file_id OR n.state IS DISTINCT FROM o.state THEN 'changed' END AS change
  FROM last_ n FULL JOIN last_ o ON n.root = o.root AND n.path = o.path AND n.idx = o.idx + 1),
changes AS (
  SELECT p.root, h.snapshot_no::BIGINT AS snapshot_no, p.path, p.change
  FROM pairs p JOIN heads h ON h.root = p.root AND h.idx = p.idx
  WHERE p.change IS NOT NULL AND p.idx > 1)
"""

#: A string that holds a JSON object or array stands for what it holds.
_OPENED = r"CASE WHEN json_type({0}) = 'VARCHAR' AND regexp_matches({0} ->> '$', '^\s*[{{\[]') AND json_valid({0} ->> '$') THEN ({0} ->> '$')::JSON ELSE {0} END"
_STEP = "{{'kind': '{kind}', 'name': {name}, 'key': {key}, 'parent': {parent}, 'pos': {pos}, 'v': {value}}}"
_ELEMENT = dict(name="name", key="key || '[' || i || ']'", parent="parent", pos="i", value="json_extract(v, '$[' || i || ']')")
_P5 = f"""
WITH RECURSIVE latest AS (SELECT raw_id, arg_max(body, received_at) AS body FROM raw_record GROUP BY raw_id),
good AS (SELECT raw_id, body::JSON AS body FROM latest WHERE json_valid(body)),
start AS (SELECT raw_id, unnest([{{'name': 'extraction', 'v': json_extract(body, '$.extraction')}}, {{'name': 'error', 'v': json_extract(body, '$.error')}}]) AS s FROM good WHERE json_type(body) = 'OBJECT'),
w AS (SELECT raw_id, 'walk' AS kind, s.name AS name, s.name AS key, 'record' AS parent, 0::BIGINT AS pos, {_OPENED.format("s.v")} AS v FROM start WHERE s.v IS NOT NULL
UNION ALL
SELECT raw_id, e.kind, e.name, e.key, e.parent, e.pos, {_OPENED.format("e.v")} FROM (SELECT raw_id, unnest(
  CASE WHEN kind = 'field' AND name IN {COLLECTIONS} THEN
    CASE WHEN json_type(v) = 'ARRAY' THEN list_transform(range(0, json_array_length(v)::BIGINT), lambda i: {_STEP.format(kind="item", **_ELEMENT)})
    ELSE [{_STEP.format(kind="item", name="name", key="key || '[0]'", parent="parent", pos="0::BIGINT", value="v")}] END
  WHEN json_type(v) = 'OBJECT' THEN list_transform(json_keys(v), lambda k: {_STEP.format(kind="field", name="k", key="key || '.' || k", parent="CASE WHEN kind = 'item' THEN key ELSE parent END", pos="0::BIGINT", value=f"json_extract(v, '$.{chr(34)}' || k || '{chr(34)}')")})
  WHEN json_type(v) = 'ARRAY' THEN list_transform(range(0, json_array_length(v)::BIGINT), lambda i: {_STEP.format(kind="walk", **_ELEMENT)}) END) AS e FROM w)),
found AS (SELECT raw_id, name AS tag, parent AS parent_key, key AS child_key, pos FROM w WHERE kind = 'item' AND json_type(v) = 'OBJECT')
"""

QUERIES = {"p1_found": p1_found, "p1_runs": p1_runs, "p5_found": p5_found, "p5_tables": p5_tables, "p6_found": p6_found, "p6_summary": p6_summary}
SQL = {
    "p1_found": _P1 + "SELECT run_no, rev_id FROM taken",
    "p1_runs": _P1 + "SELECT run_no, count(*) AS taken, count(DISTINCT (root, path)) AS paths FROM taken GROUP BY run_no",
    "p5_found": _P5 + "SELECT raw_id, parent_key, child_key FROM found",
    "p5_tables": _P5 + "SELECT tag, count(*) AS n_rows, count(*) FILTER (parent_key = 'record') AS of_records, max(pos)::BIGINT AS max_position FROM found GROUP BY tag",
    "p6_found": _P6 + "SELECT root, snapshot_no, path, change FROM changes",
    "p6_summary": _P6 + "SELECT root, snapshot_no, change, count(*) AS paths FROM changes GROUP BY ALL",
}
