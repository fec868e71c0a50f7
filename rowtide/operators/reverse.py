"""Inverse statements: for each change, the SQL that undoes it.

``with_statements`` adds two columns and never throws: ``statement``, or ``refusal``
with the reason why there is none.  ``plan`` is all or nothing: it looks for a refusal
first and only then hands out statements, newest change first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Refused
from ..functions.values import equal_cells, let, literal, qualified, quote_identifier, unrenderable
from ..model import DELETE, INSERT, SCHEMA_CHANGE, UPDATE


def _table() -> Column:
    return qualified(F.col("schema_name"), F.col("table_name"))



def _pairs(image: str) -> Column:
    """(c, v): column and cell of each value of an image."""
    return F.zip_with("columns", image, lambda c, v: F.struct(c.alias("c"), v.alias("v")))


def _rendered(pairs: Column) -> Column:
    """(c, v, s): with the literal, which only the cells that a statement names need."""
    return F.transform(pairs, lambda p: F.struct(p["c"].alias("c"), p["v"].alias("v"), literal(p["v"]).alias("s")))


def _located() -> Column:
    """What finds a row: its key columns, or every column where there is no key."""
    keyed = F.exists("columns", lambda c: c["primary_key"])
    return F.filter(_pairs("after"), lambda p: p["c"]["primary_key"] | ~keyed)


def where_clause(located: Column) -> Column:
    """The locating columns by value; NULL by IS NULL."""
    test = lambda p: F.concat(quote_identifier(p["c"]["name"]), F.when(p["v"].isNull(), F.lit(" IS NULL")).otherwise(F.concat(F.lit(" = "), p["s"])))
    return F.array_join(F.transform(located, test), " AND ")


def changed_columns() -> Column:
    """(column, cell before) where the update changed the cell."""
    kept = F.zip_with(_pairs("before"), "after", lambda p, a: F.when(~equal_cells(p["v"], a), p))
    return F.filter(kept, lambda p: p.isNotNull())


def undo_insert(x: Column) -> Column:
    return F.concat(F.lit("DELETE FROM "), _table(), F.lit(" WHERE "), where_clause(x["located"]), F.lit(" LIMIT 1;"))


def undo_update(x: Column) -> Column:
    assign = F.transform(x["writable"], lambda p: F.concat(quote_identifier(p["c"]["name"]), F.lit(" = "), p["s"]))
    return F.concat(F.lit("UPDATE "), _table(), F.lit(" SET "), F.array_join(assign, ", "), F.lit(" WHERE "), where_clause(x["located"]), F.lit(" LIMIT 1;"))


def undo_delete(x: Column) -> Column:
    names = F.array_join(F.transform(x["writable"], lambda p: quote_identifier(p["c"]["name"])), ", ")
    values = F.array_join(F.transform(x["writable"], lambda p: p["s"]), ", ")
    return F.concat(F.lit("INSERT INTO "), _table(), F.lit(" ("), names, F.lit(") VALUES ("), values, F.lit(");"))


def _image_refusal(image: str) -> Column:
    size = F.coalesce(F.nullif(F.size(image), F.lit(-1)), F.lit(0))
    said = F.concat(F.lit(f"{image} image for "), _table(), F.lit(" has "), size.cast("string"), F.lit(" values for "), F.size("columns").cast("string"), F.lit(" columns"))
    return F.when(size != F.size("columns"), said)


def _value_refusal(triples: Column) -> Column:
    bad = F.filter(triples, lambda p: p["s"].isNull())
    return F.get(F.transform(bad, lambda p: F.coalesce(unrenderable(p["v"]), F.lit("a value cannot be rendered"))), F.lit(0))


def refusal(x: Column) -> Column:
    """Why a row change cannot be undone; null if it can, and for schema changes."""
    op = F.col("op")
    insert = F.coalesce(_image_refusal("after"), _value_refusal(x["located"]))
    update = F.coalesce(
        _image_refusal("before"),
        _image_refusal("after"),
        F.when(x["n_changed"] == 0, F.concat(F.lit("update changed no columns on "), _table(), F.lit(", nothing to revert"))),
        F.when(F.size(x["writable"]) == 0, F.concat(F.lit("every column the update changed on "), _table(), F.lit(" is read-only, nothing to restore"))),
        _value_refusal(x["writable"]),
        _value_refusal(x["located"]),
    )
    delete = F.coalesce(
        _image_refusal("before"),
        F.when(F.size(x["writable"]) == 0, F.concat(F.lit("every column of "), _table(), F.lit(" is read-only, nothing to insert"))),
        _value_refusal(x["writable"]),
    )
    return (
        F.when(op == SCHEMA_CHANGE, F.lit(None).cast("string"))
        .when(F.col("columns").isNull() | (F.size("columns") <= 0), F.concat(F.lit("change of "), _table(), F.lit(" carries no columns")))
        .when(op == INSERT, insert)
        .when(op == UPDATE, update)
        .when(op == DELETE, delete)
        .otherwise(F.concat(F.lit("unsupported operation "), F.coalesce(op.cast("string"), F.lit("null")), F.lit(" on "), _table()))
    )


def outcome() -> Column:
    """Struct of refusal and statement.

    Every part is bound once (``let``): a filter on the result may be pushed below its
    projection, and would copy whatever is not bound.
    """
    op = F.col("op")

    def settled(changed: Column) -> Column:
        writable = _rendered(F.filter(changed, lambda p: ~p["c"]["read_only"]))
        located = F.when(op != DELETE, _rendered(_located()))
        return F.struct(F.size(changed).alias("n_changed"), writable.alias("writable"), located.alias("located"))

    def result(x: Column) -> Column:
        made = F.when(op == INSERT, undo_insert(x)).when(op == UPDATE, undo_update(x)).when(op == DELETE, undo_delete(x))
        return let(refusal(x), lambda why: F.struct(why.alias("refusal"), F.when(why.isNull(), made).alias("statement")))

    changed = F.when(op == UPDATE, changed_columns()).when(op == DELETE, _pairs("before"))
    return let(changed, lambda c: let(settled(c), result))


def with_statements(changes: DataFrame) -> DataFrame:
    """Every change with ``refusal`` and ``statement``; schema changes have neither."""
    made = changes.withColumn("__outcome", outcome())
    return made.select(*changes.columns, F.col("__outcome.refusal").alias("refusal"), F.col("__outcome.statement").alias("statement"))


def plan(changes: DataFrame, *order: str) -> DataFrame:
    """Row changes with their statements, newest first; refused whole if any is refused."""
    keys = order or ("change_id",)
    checked = with_statements(changes.where(F.col("op") != SCHEMA_CHANGE))
    bad = checked.where(F.col("refusal").isNotNull()).orderBy(*[F.col(k).asc() for k in keys]).select(*keys, "refusal").first()
    if bad:
        raise Refused(f"change {', '.join(str(bad[k]) for k in keys)}: {bad['refusal']}")
    return checked.drop("refusal").orderBy(*[F.col(k).desc() for k in keys])
