"""Rendering of typed cells as SQL literals and as display text, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import BOOL, BYTES, FLOAT32, FLOAT64, INT, RAW, STRING, TIME, UINT
from .predicates import printable_one_line, safe_to_quote, valid_raw

#: Bytes of one value that a comment carries.
COMMENT_BYTES = 200


def quote_identifier(name: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def qualified(schema: Column, table: Column) -> Column:
    return F.concat(quote_identifier(schema), F.lit("."), quote_identifier(table))


def hex_literal(raw: Column) -> Column:
    return F.concat(F.lit("X'"), F.hex(raw), F.lit("'"))


def quote_bytes(raw: Column) -> Column:
    """Quoted where that is unambiguous, else a hex literal."""
    quoted = F.concat(F.lit("'"), F.replace(raw.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(safe_to_quote(raw), quoted).otherwise(hex_literal(raw))


def time_text(t: Column) -> Column:
    """UTC wall clock, with microseconds only if there are any."""
    fine = F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.regexp_replace(fine, r"\.000000$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(text: Column) -> Column:
    """Struct of the significant digits and the decimal exponent of the first one."""

    def parts(t: Column) -> Column:
        return F.struct(
            F.length(F.regexp_extract(t, r"^-?([0-9]+)", 1)).alias("whole"),
            F.concat(F.regexp_extract(t, r"^-?([0-9]+)", 1), F.regexp_extract(t, r"^-?[0-9]+\.([0-9]+)", 1)).alias("every"),
            F.coalesce(F.regexp_extract(t, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0)).alias("power"),
        )

    def result(p: Column) -> Column:
        lead = F.length(p["every"]) - F.length(F.regexp_replace(p["every"], "^0+", ""))
        return F.struct(F.regexp_replace(p["every"], "^0+|0+$", "").alias("digits"), (p["whole"] + p["power"] - lead - 1).cast("int").alias("first"))

    return let(parts(text), result)


def _shortest(x: Column, kind: str) -> Column:
    """Shortest digits that read back as ``x``, as a struct like that of ``_digits``.

    The platform's own text may hold one digit too many; one less is tried.
    """

    def choose(d: Column) -> Column:
        fewer = F.floor((F.coalesce(F.nullif(d["digits"], F.lit("")), F.lit("0")).cast("decimal(20,0)") + 5) / 10).cast("decimal(20,0)").cast("string")
        again = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), fewer, F.lit("E"), (d["first"] - F.length(d["digits"]) + 2).cast("string"))
        return let(again, lambda t: F.when((F.length(d["digits"]) > 1) & F.coalesce(t.try_cast(kind) == x, F.lit(False)), _digits(t)).otherwise(d))

    return let(_digits(x.cast("string")), choose)


def float_text(x: Column, kind: str) -> Column:
    """``x`` (float or double) as the shortest general-format number: plain digits for
    exponents from -4 to 5, else an exponent of two digits at least."""

    def written(d: Column) -> Column:
        digits, first = d["digits"], d["first"]
        n = F.length(digits)
        tail = F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(F.lit(""))
        exponent = F.concat(F.when(first < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(first).cast("string"), F.greatest(F.length(F.abs(first).cast("string")), F.lit(2)), F.lit("0")))
        return (
            F.when((first < -4) | (first >= EXPONENT_FROM), F.concat(F.substr(digits, F.lit(1), F.lit(1)), tail, F.lit("e"), exponent))
            .when(first < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -first - 1), digits))
            .when(n <= first + 1, F.concat(digits, F.repeat(F.lit("0"), first + 1 - n)))
            .otherwise(F.concat(F.substr(digits, F.lit(1), first + 1), F.lit("."), F.substr(digits, first + 2)))
        )

    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), F.lit("-")).otherwise(F.lit(""))
    return (
        F.when(F.isnan(x), F.lit("NaN"))
        .when(x == float("inf"), F.lit("+Inf"))
        .when(x == float("-inf"), F.lit("-Inf"))
        .when(x == 0, F.concat(sign, F.lit("0")))
        .otherwise(F.concat(sign, let(_shortest(x, kind), written)))
    )


#: First decimal exponent that is written with an exponent.
EXPONENT_FROM = 6


def _numbers(c: Column) -> Column:
    return (
        F.when(c["tag"] == INT, c["i"].cast("string"))
        .when(c["tag"] == UINT, c["u"].cast("string"))
        .when(c["tag"] == BOOL, F.when(c["b"], F.lit("1")).otherwise(F.lit("0")))
        .when(c["tag"] == RAW, F.when(valid_raw(c["raw"]), c["raw"]))
        .when(c["tag"] == FLOAT64, float_text(c["d"], "double"))
        .when(c["tag"] == FLOAT32, float_text(c["f"], "float"))
    )


def literal(c: Column) -> Column:
    """SQL literal of a cell; null if the cell cannot be rendered (see ``unrenderable``)."""
    return (
        F.when(c.isNull(), F.lit("NULL"))
        .when(c["tag"].isin(STRING, BYTES), quote_bytes(c["bin"]))
        .when(c["tag"] == TIME, F.concat(F.lit("'"), time_text(c["t"]), F.lit("'")))
        .otherwise(_numbers(c))
    )


def display(c: Column) -> Column:
    """Text of a cell for reading; null for SQL NULL and for what cannot be rendered."""
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(c["tag"].isin(STRING, BYTES), F.when(safe_to_quote(c["bin"]), c["bin"].cast("string")).otherwise(hex_literal(c["bin"])))
        .when(c["tag"] == TIME, time_text(c["t"]))
        .otherwise(_numbers(c))
    )


def unrenderable(c: Column) -> Column:
    """Why a cell has no literal; null if it has one."""
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when((c["tag"] == RAW) & ~valid_raw(c["raw"]), F.lit("a raw value is not a number and raw values are emitted unquoted"))
        .when(c["tag"].isNull() | ~c["tag"].between(INT, RAW), F.lit("a value has an unsupported type"))
    )


def equal_cells(a: Column, b: Column) -> Column:
    """Deep equality, tag included; NaN equals nothing, two SQL NULLs are equal."""
    nan = F.coalesce(F.isnan(a["d"]) | F.isnan(b["d"]), F.lit(False)) | F.coalesce(F.isnan(a["f"]) | F.isnan(b["f"]), F.lit(False))
    return a.eqNullSafe(b) & ~nan


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def comment_safe(raw: Column) -> Column:
    """The bytes as they may stand on a comment line, cut after COMMENT_BYTES bytes at a
    character boundary; what is left out is named by its size."""
    size = F.octet_length(raw)
    total = plural(size, "byte")
    head = None
    for back in range(4):
        part = F.substring(raw, 1, COMMENT_BYTES - back).cast("string")
        whole = F.is_valid_utf8(part)
        head = F.when(whole, part) if head is None else head.when(whole, part)
    short = F.concat(head, F.lit("… <truncated, "), total, F.lit(" total>"))
    return (
        F.when(~printable_one_line(raw), F.concat(F.lit("<unprintable, "), total, F.lit(">")))
        .when(size > COMMENT_BYTES, short)
        .otherwise(raw.cast("string"))
    )
