"""Predicates over changes and over the text they carry, as Columns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import SCHEMA_CHANGE


class Refused(Exception):
    """The question cannot be answered completely; the message says why, ``rule`` in a word."""

    def __init__(self, message: str, rule: str = ""):
        super().__init__(message)
        self.rule = rule


class BadRequest(Refused):
    """The question itself makes no sense."""


@dataclass(frozen=True)
class Filter:
    """Tables (bare or schema-qualified, any case) and inclusive time bounds; empty: all."""

    tables: tuple[str, ...] = ()
    start: datetime | None = None
    end: datetime | None = None

    def __post_init__(self):
        object.__setattr__(self, "tables", tuple(t.strip() for t in self.tables if t.strip()))
        if self.start and self.end and self.end < self.start:
            raise BadRequest(f"the end of the window ({self.end}) lies before its start ({self.start}), so nothing can match")


def table_matches(tables: Iterable[str], schema: Column, table: Column) -> Column:
    """Case-insensitive equality to ``table`` or ``schema.table``; no tables: all."""
    wanted = [t.lower() for t in tables]
    if not wanted:
        return F.lit(True)
    return F.lower(table).isin(wanted) | F.lower(F.concat_ws(".", schema, table)).isin(wanted)


def matches(f: Filter, *, schema: str = "schema_name", table: str = "table_name", op: str = "op", moment: str = "committed_at") -> Column:
    """The filter as one Column; schema changes pass the table test but not the time test.

    Bounds are literals against the bare column, so they reach the Parquet scan.
    """
    out = F.lit(True)
    if f.start is not None:
        out = out & (F.col(moment) >= F.lit(f.start))
    if f.end is not None:
        out = out & (F.col(moment) <= F.lit(f.end))
    if f.tables:
        out = out & ((F.col(op) == SCHEMA_CHANGE) | table_matches(f.tables, F.col(schema), F.col(table)))
    return out


def is_schema_change(op: Column) -> Column:
    return op == SCHEMA_CHANGE


def is_ddl(statement: Column) -> Column:
    """True for statements that begin with a schema-changing keyword and a space."""
    bare = F.regexp_replace(statement, r"^\s+", "")
    return F.coalesce(F.upper(bare).rlike(r"^(?:ALTER|CREATE|DROP|RENAME|TRUNCATE) "), F.lit(False))


def valid_raw(text: Column) -> Column:
    """True for a plain number, the only text that is ever emitted unquoted."""
    return F.coalesce(text.rlike(r"\A[+-]?[0-9]+(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?\z"), F.lit(False))


def safe_to_quote(raw: Column) -> Column:
    """True if the bytes mean the same between quotes under every server setting."""
    text = raw.cast("string")
    return F.is_valid_utf8(text) & ~text.rlike(r"[\x00-\x1f\x7f\\]")


def printable_one_line(raw: Column) -> Column:
    """True if the bytes can stand on a comment line: valid text, no controls, no
    separators or format marks, and the plain space as the only space."""
    text = raw.cast("string")
    return F.is_valid_utf8(text) & ~text.rlike(r"[\p{C}\p{Z}&&[^ ]]")
