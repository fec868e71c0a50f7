"""Revert scripts: what a person reads before deciding to run it."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.moments import describe_window, plural, stamp_column
from ..functions.predicates import Filter, Refused
from ..functions.values import comment_safe
from ..functions.values import plural as plural_column
from ..model import SCHEMA_CHANGE, op_name
from ..operators.reverse import plan

# The lines that make a script.
TITLE = "-- rowtide revert script"
NOTHING = "-- no matching changes found"
REVIEW = "-- REVIEW BEFORE RUNNING — nothing here has been executed."
PINS = ("", "SET time_zone = '+00:00';", "SET NAMES utf8mb4;")


def _safe(c: str) -> Column:
    return comment_safe(F.col(c).cast("binary"))


def block(moment: str = "committed_at") -> Column:
    """Provenance and statement of one reversal, as the lines of a script."""
    head = F.concat(
        F.lit("-- undo "), op_name(F.col("op")), F.lit(" "), _safe("schema_name"), F.lit("."), _safe("table_name"), F.lit(" — "),
        _safe("log_file"), F.lit(":"), F.col("log_pos").cast("string"), F.lit(" at "), stamp_column(F.col(moment)),
    )
    cause = F.when(F.coalesce(F.col("query"), F.lit("")) != "", F.concat(F.lit("-- caused by: "), _safe("query")))
    return F.concat_ws("\n", F.lit(""), head, cause, F.col("statement"))


def schema_change_lines(ddl: DataFrame, *order: str, moment: str = "committed_at") -> DataFrame:
    """One comment line for each schema change, oldest first."""
    line = F.concat(F.lit("--   "), stamp_column(F.col(moment)), F.lit(" at "), _safe("log_file"), F.lit(":"), F.col("log_pos").cast("string"), F.lit(" — "), _safe("query"))
    return ddl.where(F.col("op") == SCHEMA_CHANGE).orderBy(*(order or ("change_id",))).select(line.alias("line"))


def warning(lines: list[str]) -> list[str]:
    if not lines:
        return []
    return [
        "--",
        f"-- WARNING: {plural(len(lines), 'schema change')} in this window. The statements below",
        "-- describe each table as it was then. A dropped or renamed column makes the script",
        "-- fail; a retyped one takes a converted value without an error. Check first:",
        *lines,
    ]


def header(source: str, f: Filter, ddl_lines: list[str], count: int | None = None) -> list[str]:
    lines = [TITLE, f"-- source: {printable(source)}"]
    window = describe_window(f)
    if window:
        lines.append(f"-- window: {window}")
    lines.append("-- newest change first" if count is None else f"-- {plural(count, 'statement')}, newest change first")
    return [*lines, REVIEW, *warning(ddl_lines), *PINS]


def trailer(count: int) -> list[str]:
    return ["", f"-- end of script: {plural(count, 'statement')}"] if count else [NOTHING]


def printable(text: str) -> str:
    """The driver's form of ``comment_safe``, for labels that are no data."""
    raw = text.encode("utf-8", "surrogateescape")
    if not text.isprintable():
        return f"<unprintable, {plural(len(raw), 'byte')}>"
    if len(raw) > 200:
        return f"{raw[:200].decode('utf-8', 'ignore')}… <truncated, {plural(len(raw), 'byte')} total>"
    return text


def script_lines(changes: DataFrame, source: str, f: Filter | None = None, *order: str, moment: str = "committed_at") -> Iterator[str]:
    """The whole script, line by line; statements stream from the cluster in order.

    A change that cannot be undone refuses the script before its first line.  Schema
    changes are listed above the statements; the trailer marks the script complete.
    """
    f, order = f or Filter(), order or ("change_id",)
    reversals = plan(changes, *order).select(block(moment).alias("block"))
    ddl = [r["line"] for r in schema_change_lines(changes, *order, moment=moment).toLocalIterator()]
    count = 0
    yield from header(source, f, ddl)
    for row in reversals.toLocalIterator(prefetchPartitions=True):
        count += 1
        yield from row["block"].split("\n")
    yield from trailer(count)


def script_frame(changes: DataFrame, source: str, f: Filter | None = None, key: str = "change_id", *, moment: str = "committed_at") -> DataFrame:
    """The script as rows (part, place, at, line), for scripts that no driver should hold.

    Parts are header, statements and trailer; ``place`` is the change, newest first within
    its part, and ``at`` the line within its block.  The count is one aggregated row.
    """
    f = f or Filter()
    made = plan(changes, key).select(F.col(key).alias("place"), F.split(block(moment), "\n").alias("lines"))
    ddl = [r["line"] for r in schema_change_lines(changes, key, moment=moment).toLocalIterator()]
    head = changes.sparkSession.createDataFrame([(0, 0, i, x) for i, x in enumerate(header(source, f, ddl))], "part int, place long, at int, line string")
    body = made.select(F.lit(1).alias("part"), "place", F.posexplode("lines").alias("at", "line"))
    n = F.col("n")
    closing = F.when(n == 0, F.array(F.lit(NOTHING))).otherwise(F.array(F.lit(""), F.concat(F.lit("-- end of script: "), plural_column(n, "statement"))))
    tail = made.agg(F.count(F.lit(1)).alias("n")).select(F.lit(2).alias("part"), F.lit(0).cast("long").alias("place"), F.posexplode(closing).alias("at", "line"))
    return head.unionByName(body).unionByName(tail)


def render(changes: DataFrame, source: str, f: Filter | None = None, *order: str, moment: str = "committed_at") -> str:
    """A small script in one string, its count in the header as well."""
    f, order = f or Filter(), order or ("change_id",)
    blocks = [r["block"] for r in plan(changes, *order).select(block(moment).alias("block")).collect()]
    ddl = [r["line"] for r in schema_change_lines(changes, *order, moment=moment).collect()]
    lines = [*header(source, f, ddl, len(blocks)), *blocks, *trailer(len(blocks))]
    return "\n".join(lines) + "\n"


def write_lines(lines: Iterable[str], path: str, *, force: bool = False) -> None:
    """Write a file whole or not at all: a private draft beside it, synced, then renamed."""
    if os.path.exists(path) and not force:
        raise Refused(f"{path} exists already")
    folder = os.path.dirname(os.path.abspath(path))
    handle, draft = tempfile.mkstemp(prefix=f".{os.path.basename(path)}.partial-", dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:  # mkstemp gives mode 0600
            _copy(lines, out)
            out.flush()
            os.fsync(out.fileno())
        os.replace(draft, path)
    except BaseException:
        if os.path.exists(draft):
            os.unlink(draft)
        raise


def _copy(lines: Iterable[str], out: TextIO) -> None:
    for line in lines:
        out.write(line + "\n")


def write_blocks(changes: DataFrame, path: str, *order: str, moment: str = "committed_at") -> None:
    """The statements as text part files in script order, for reversals too large for one
    file; Spark's committer marks them complete."""
    plan(changes, *(order or ("change_id",))).select(block(moment).alias("value")).write.text(path)
