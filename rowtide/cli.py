"""rowtide watch | generate | status | serve | version | help.

Exit codes: 0 done, 1 refused or failed (status: unhealthy), 2 usage.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime, timedelta

from pyspark.sql import SparkSession

from .api import Api, is_loopback, serve
from .functions.moments import filter_from, split_list
from .functions.predicates import BadRequest, Refused
from .operators.normalise import mark_read_only
from .plans.claim import Claim
from .plans.script import script_lines, write_lines
from .plans.status import as_dict, as_text
from .plans.store import ChangeStore
from .sources.decoded_log import read_changes
from .streaming.collector import Collector, keep_running, read_stream

VERSION = "0.1.0"


def session() -> SparkSession:
    return SparkSession.builder.appName("rowtide").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rowtide", description="Reads row-change logs and proposes the SQL that undoes them; runs none of it.")
    commands = p.add_subparsers(dest="command", required=True)
    g = commands.add_parser("generate", help="write a revert script")
    g.add_argument("files", nargs="*")
    g.add_argument("--store")
    g.add_argument("--tables", default="")
    g.add_argument("--from", dest="start", default="")
    g.add_argument("--to", dest="end", default="")
    g.add_argument("--generated", default="")
    g.add_argument("--out")
    g.add_argument("--force", action="store_true")
    w = commands.add_parser("watch", help="collect changes into a store")
    w.add_argument("--store", required=True)
    w.add_argument("--log", required=True, help="folder of decoded log files")
    w.add_argument("--tables", default="")
    w.add_argument("--generated", default="")
    w.add_argument("--retention-days", type=float, default=7)
    w.add_argument("--max-staleness-seconds", type=int, default=300)
    w.add_argument("--once", action="store_true", help="stop when all that is there has been read")
    s = commands.add_parser("status", help="health of a store")
    s.add_argument("--store", required=True)
    s.add_argument("--json", action="store_true")
    v = commands.add_parser("serve", help="read-only HTTP facade")
    v.add_argument("--store", required=True)
    v.add_argument("--host", default="127.0.0.1")
    v.add_argument("--port", type=int, default=8080)
    commands.add_parser("version")
    commands.add_parser("help")
    return p


def generate(a: argparse.Namespace, spark: SparkSession, now: datetime) -> int:
    if bool(a.files) == bool(a.store):
        raise BadRequest("name either log files or --store")
    f = filter_from({"tables": a.tables, "from": a.start, "to": a.end}, now)
    if a.out and os.path.exists(a.out) and not a.force:
        raise BadRequest(f"{a.out} exists already; --force replaces it")
    if a.store:
        snapshot = ChangeStore(spark, a.store, create=False).snapshot()
        snapshot.gate(f, now)
        changes, label, order, moment = snapshot.changes(f), a.store, ["change_id"], "committed_at"
    else:
        changes, label = read_changes(spark, a.files, f), ", ".join(a.files)
        order, moment = ["file_ord", "event_ord", "row_ord"], "event_at"
    lines = script_lines(mark_read_only(changes, split_list(a.generated)), label, f, *order, moment=moment)
    if a.out:
        write_lines(lines, a.out, force=a.force)
    else:
        for line in lines:
            print(line)
    return 0


def watch(a: argparse.Namespace, spark: SparkSession, now: datetime) -> int:
    store = ChangeStore(spark, a.store)
    with Claim(os.path.join(a.store, "collector.lock")):
        store.set_max_staleness(timedelta(seconds=a.max_staleness_seconds))
        store.set_retention(timedelta(days=a.retention_days))
        store.open_coverage(now)
        collector = Collector(store, f=filter_from({"tables": a.tables}), read_only=split_list(a.generated))
        trigger = {"availableNow": True} if a.once else {"processingTime": "5 seconds"}
        start = lambda: collector.start(read_stream(spark, a.log), os.path.join(a.store, "stream"), **trigger)

        def upkeep() -> None:
            store.prune(datetime.now(UTC))
            store.compact()
            store.vacuum()

        keep_running(start, between=upkeep)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None, now: datetime | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] in (["help"], []):
        _parser().print_help()
        return 0 if argv else 2
    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    now = now or datetime.now(UTC)
    try:
        if a.command == "version":
            print(VERSION)
            return 0
        if a.command == "serve" and not is_loopback(a.host) and not os.environ.get("ROWTIDE_TOKEN"):
            raise BadRequest("listening beyond this machine needs ROWTIDE_TOKEN")
        spark = spark or session()
        if a.command == "generate":
            return generate(a, spark, now)
        if a.command == "watch":
            return watch(a, spark, now)
        store = ChangeStore(spark, a.store, create=False)
        if a.command == "status":
            report = store.snapshot().status(now)
            print(json.dumps(as_dict(a.store, report), ensure_ascii=False, indent=2) if a.json else as_text(a.store, report))
            return 0 if report.healthy() else 1
        serve(Api(store, a.store, token=os.environ.get("ROWTIDE_TOKEN")), a.host, a.port).serve_forever()
        return 0
    except BadRequest as e:
        print(f"rowtide: {e}", file=sys.stderr)
        return 2
    except Refused as e:
        print(f"rowtide: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
