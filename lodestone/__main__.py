"""python -m lodestone DIRECTORY [SAVED] [-o OUT]: encode a directory on a local session.

Standard output gets one JSON value, standard error a JSON line per progress event or
error; the exit code tells how the run ended. Interrupts cancel it and keep what is done.
"""

from __future__ import annotations

import argparse
import json
import os
import signal
import sys

from lodestone.plans.engine import CancellationToken, EncodeRequest, Engine, EngineConfig
from lodestone.session import local_session
from lodestone.sources.vector_file import bundle_of, json_schema, read_json, records_of, write_json
from lodestone.types import LodestoneError


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="lodestone")
    args.add_argument("directory", nargs="?")
    args.add_argument("saved", nargs="?")
    args.add_argument("-o", "--output")
    args.add_argument("--backend", default="cpu")
    args.add_argument("--workers", type=int, default=2)
    args.add_argument("--batches", type=int, default=1)
    args.add_argument("--schema", action="store_true", help="print the JSON schema of results and end")
    args.add_argument("--deadline", type=float, default=300.0, help="seconds a reader may take for one file")
    given = args.parse_args(argv)
    if given.schema:
        print(json.dumps(json_schema(), indent=1, sort_keys=True))
        return 0
    if given.directory is None:
        args.error("a directory is needed")
    try:
        return _run(given)
    except LodestoneError as e:
        print(json.dumps({"type": "error", "error": e.as_dict()}), file=sys.stderr, flush=True)
        return e.exit_code


def _run(given: argparse.Namespace) -> int:
    config = EngineConfig(given.backend, given.workers, batches=given.batches, deadline=given.deadline)
    saved = read_json(given.saved) if given.saved else None
    if given.output and os.path.lexists(given.output):
        read_json(given.output)  # only a valid result is ever replaced
    cancel = CancellationToken()
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda *_: cancel.cancel())
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    try:
        outside = tuple(os.path.abspath(p) for p in (given.saved, given.output) if p)
        tell = lambda p: print(json.dumps({"type": "progress", "data": p}), file=sys.stderr, flush=True)
        result = Engine(spark, config).encode(EncodeRequest(os.path.abspath(given.directory), outside), records_of(spark, saved) if saved else None, cancel, tell)
        bundle = bundle_of(result.records, result.directory, result.summary, result.complete)
        if given.output:
            write_json(given.output, bundle)
        print(json.dumps(bundle, ensure_ascii=False, separators=(",", ":")), flush=True)
        return result.exit_code
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
