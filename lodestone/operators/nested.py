"""Deeply nested records to flat child tables: single-pass tagged emission.

A depth-first visitor walks each body once and emits (tag, key, parent key, payload) for
every object in a collection. The tagged rows are one table, written partitioned by tag;
each tag then gets its own schema, so parents and children stay joined by their keys.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The names of fields that hold collections of child objects.
COLLECTIONS = ("windows", "peaks", "frames", "regions", "tiles", "parts", "notes", "page_text", "attempts", "steps")
SCHEMA = "raw_id long, tag string, parent_key string, child_key string, position long, payload string"


def _refuse(text: str):
    raise ValueError(f"{text} is no JSON value")


def parse(text: str | None):
    """The JSON value of text; None where it is null or no valid JSON."""
    try:
        return None if text is None else json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None


def _opened(value):
    """A string that holds a JSON object or array stands for what it holds."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        inner = parse(value)
        return value if inner is None else inner
    return value


def visit(record, roots: tuple[str, ...], collections: frozenset[str]) -> Iterator[tuple[str, str, str, int, dict]]:
    """(tag, parent key, child key, position, object) depth first, with an own stack.

    Fields of an object that are collections lead to cases, any other object or array is
    walked through. A lone object in place of a collection is its element 0. Null elements
    and elements that are no object are no case but keep their place.
    """
    if not isinstance(record, dict):
        return
    stack = [("walk", name, record[name], name, "record") for name in reversed(roots) if record.get(name) is not None]
    while stack:
        kind, name, value, path, parent = stack.pop()
        value = _opened(value)
        if kind == "field" and name in collections:
            items = value if isinstance(value, list) else [value]
            for i in range(len(items) - 1, -1, -1):
                stack.append(("item", name, items[i], f"{path}[{i}]", parent))
            continue
        if kind == "item":
            if not isinstance(value, (dict, list)):
                continue
            if isinstance(value, dict):
                yield name, parent, path, int(path[path.rindex("[") + 1 : -1]), value
                parent = path
        if isinstance(value, dict):
            stack.extend(("field", k, v, f"{path}.{k}", parent) for k, v in reversed(value.items()) if isinstance(v, (dict, list, str)))
        elif isinstance(value, list):
            stack.extend(("walk", name, v, f"{path}[{i}]", parent) for i, v in reversed([*enumerate(value)]) if isinstance(v, (dict, list, str)))


def _own(value: dict, collections: frozenset[str]) -> str:
    """An object as JSON without the collections in it, at any depth: their objects are rows
    of their own."""
    out: dict = {}
    stack = [(value, out)]
    while stack:
        here, copy = stack.pop()
        for key, x in here.items() if isinstance(here, dict) else enumerate(here):
            if isinstance(here, dict) and key in collections:
                continue
            if isinstance(x, (dict, list)):
                x, old = ({} if isinstance(x, dict) else []), x
                stack.append((old, x))
            if isinstance(copy, dict):
                copy[key] = x
            else:
                copy.append(x)
    return json.dumps(out, sort_keys=True, ensure_ascii=False)


def latest_bodies(raw: DataFrame) -> DataFrame:
    """Per raw_id the body received last; equal times: the greatest body, null least."""
    return raw.groupBy("raw_id").agg(F.max(F.struct("received_at", "body")).alias("r")).select("raw_id", F.col("r.body").alias("body"))


def flatten(raw: DataFrame, roots: tuple[str, ...] = ("extraction", "error"), collections: tuple[str, ...] = COLLECTIONS) -> DataFrame:
    """Every object of a collection in the latest body of each raw_id, as a tagged row.

    tag is the collection's name, child_key the dotted path with zero-based indexes,
    parent_key the child_key of the nearest enclosing case or `record`, payload the
    object's own fields as JSON. Bodies that are null, no valid JSON or no object give
    nothing, as do empty collections; other columns of raw are ignored.
    """
    wanted = frozenset(collections)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [], [], [])
            for raw_id, body in zip(batch["raw_id"].to_pylist(), batch["body"].to_pylist()):
                for tag, parent, key, at, value in visit(parse(body), roots, wanted):
                    for column, x in zip(out, (raw_id, tag, parent, key, at, _own(value, wanted))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(out[i], pa.string()) for i in (1, 2, 3)], pa.array(out[4], pa.int64()), pa.array(out[5], pa.string())], names=["raw_id", "tag", "parent_key", "child_key", "position", "payload"])

    return latest_bodies(raw).mapInArrow(emit, SCHEMA)


def write_tables(flat: DataFrame, path: str) -> None:
    """Write the tagged rows partitioned by tag: one pass, one folder per child table."""
    flat.write.partitionBy("tag").mode("overwrite").parquet(path)


def child_table(flat: DataFrame, tag: str, fields: str) -> DataFrame:
    """The table of one tag under its schema, as `start_seconds double, samples long`."""
    return flat.where(F.col("tag") == tag).select("raw_id", "parent_key", "child_key", "position", F.from_json("payload", fields).alias("p")).select("raw_id", "parent_key", "child_key", "position", "p.*")
