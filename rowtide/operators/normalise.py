"""From decoded log events to row changes.

A decoded event is one row: log_file, file_ord, event_ord, event_type, log_pos,
event_size, event_at, server_id, schema_name, table_name, names, pk, skipped, images,
statement.  ``images`` holds the row images in log order: one for each inserted or
deleted row, a before and an after image for each updated one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Filter, Refused, is_ddl, matches
from ..model import DELETE, INSERT, SCHEMA_CHANGE, UPDATE
from .running import running_sum

EVENT_SCHEMA = (
    "log_file string, file_ord int, event_ord long, event_type string, log_pos long, event_size long, event_at timestamp, "
    "server_id long, schema_name string, table_name string, names array<string>, pk array<int>, skipped array<array<int>>, "
    "images array<array<struct<tag:tinyint,i:long,u:decimal(20,0),f:float,d:double,b:boolean,bin:binary,t:timestamp,raw:string>>>, "
    "statement string, gtid string"
)
# Event types and the operation they carry.
WRITE_EVENTS = ("WRITE_ROWS_V0", "WRITE_ROWS_V1", "WRITE_ROWS_V2", "WRITE_ROWS_COMPRESSED_V1")
UPDATE_EVENTS = ("UPDATE_ROWS_V0", "UPDATE_ROWS_V1", "UPDATE_ROWS_V2", "UPDATE_ROWS_COMPRESSED_V1")
DELETE_EVENTS = ("DELETE_ROWS_V0", "DELETE_ROWS_V1", "DELETE_ROWS_V2", "DELETE_ROWS_COMPRESSED_V1")
PARTIAL_UPDATE = "PARTIAL_UPDATE_ROWS"
ROW_EVENTS = (*WRITE_EVENTS, *UPDATE_EVENTS, *DELETE_EVENTS, PARTIAL_UPDATE)
#: A log file begins with so many bytes of magic.
FIRST_POSITION = 4


def op_of(event_type: Column) -> Column:
    """Operation of a row event; null for what is none, or what cannot be reversed."""
    return (
        F.when(event_type.isin(*WRITE_EVENTS), F.lit(INSERT))
        .when(event_type.isin(*UPDATE_EVENTS), F.lit(UPDATE))
        .when(event_type.isin(*DELETE_EVENTS), F.lit(DELETE))
        .cast("tinyint")
    )


def with_positions(events: DataFrame, *, file: str = "log_file", order: str = "event_ord") -> DataFrame:
    """``log_pos`` as logged, or where the scan has got to where the log wrote none.

    A running sum over each file, stretch by stretch.
    """
    scanned = running_sum(events, F.col("event_size"), "__scanned", [file], [order])
    placed = F.coalesce(F.nullif(F.col("log_pos"), F.lit(0)), F.col("__scanned") + FIRST_POSITION)
    return scanned.withColumn("log_pos", placed).drop("__scanned")


def columns_of(names: Column, pk: Column) -> Column:
    """Column descriptions from names and the ordinals of the key."""
    return F.transform(
        names,
        lambda n, i: F.struct(n.alias("name"), F.coalesce(F.array_contains(pk, i), F.lit(False)).alias("primary_key"), F.lit(False).alias("read_only")),
    )


def refusal_of_event() -> Column:
    """Why a row event cannot be turned into changes; null if it can."""
    table = F.concat_ws(".", "schema_name", "table_name")
    where = F.concat(F.col("log_file"), F.lit(":"), F.coalesce(F.col("log_pos").cast("string"), F.lit("?")))
    n = F.coalesce(F.size("images"), F.lit(0))
    return (
        F.when(F.col("event_type") == PARTIAL_UPDATE, F.concat(F.lit("partial JSON update of "), table, F.lit(" cannot be reversed")))
        .when(op_of(F.col("event_type")).isNull(), F.concat(F.col("event_type"), F.lit(" is not a row event")))
        .when(F.col("table_name").isNull(), F.concat(F.lit("rows event at "), where, F.lit(" has no table map")))
        .when(F.coalesce(F.exists("skipped", lambda s: F.size(s) > 0), F.lit(False)), F.concat(F.lit("row image for "), table, F.lit(" is partial")))
        .when(F.col("names").isNull() | F.coalesce(F.exists("names", lambda x: x.isNull()), F.lit(False)), F.concat(F.lit("log carries no column names for "), table))
        .when(
            F.coalesce(F.exists("pk", lambda i: (i < 0) | (i >= F.size("names"))), F.lit(False)),
            F.concat(F.lit("primary key column is out of range for "), table),
        )
        .when(
            (op_of(F.col("event_type")) == UPDATE) & (n % 2 != 0),
            F.concat(F.lit("update event for "), table, F.lit(" at "), where, F.lit(" has an odd number of row images")),
        )
    )


def explode_images(events: DataFrame) -> DataFrame:
    """One row for each changed row: op, row_ord, columns, before, after.

    The images of an update come in pairs; no event is shuffled.
    """
    op = op_of(F.col("event_type"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("images") - 2, F.lit(0)), F.lit(2)),
        lambda i: F.struct(F.get("images", i).alias("before"), F.get("images", i + 1).alias("after")),
    )
    image = events.schema["images"].dataType.elementType
    none = F.lit(None).cast(image)
    single = F.transform(
        "images",
        lambda x: F.struct(F.when(op == DELETE, x).otherwise(none).alias("before"), F.when(op == INSERT, x).otherwise(none).alias("after")),
    )
    rows = F.when(F.size("images") <= 0, F.slice(single, 1, 0)).when(op == UPDATE, pairs).otherwise(single)
    return (
        events.select("*", op.alias("op"), columns_of(F.col("names"), F.col("pk")).alias("columns"), F.posexplode(rows).alias("row_ord", "row"))
        .select("*", F.col("row.before").alias("before"), F.col("row.after").alias("after"))
        .drop("row", "images", "names", "pk", "skipped")
    )


def file_changes(events: DataFrame, f: Filter | None = None) -> DataFrame:
    """Changes of a scan over whole files, in log order, filtered by event time.

    Row events become rows, schema-changing statements changes of their own; the rest of
    the log is skipped.  An event that cannot be read refuses the whole scan, in
    whatever table it lies, and does so before anything is returned.
    """
    placed = with_positions(events)
    is_rows = F.col("event_type").isin(*ROW_EVENTS)
    bad = placed.where(is_rows).withColumn("refusal", refusal_of_event()).where("refusal is not null")
    first = bad.orderBy("file_ord", "event_ord").select("refusal").first()
    if first:
        raise Refused(first["refusal"])
    keep = ["file_ord", "event_ord", "row_ord", "event_at", "server_id", "schema_name", "table_name", "op", "log_file", "log_pos", "query", "columns", "before", "after"]
    rows = explode_images(placed.where(is_rows)).withColumn("query", F.lit(None).cast("string")).select(*keep)
    kinds = {x.name: x.dataType for x in rows.schema}
    ddl = placed.where((F.col("event_type") == "QUERY") & is_ddl(F.col("statement")))
    ddl = ddl.select(
        "file_ord", "event_ord", F.lit(0).alias("row_ord"), "event_at", "server_id", "schema_name", F.lit("").alias("table_name"),
        F.lit(SCHEMA_CHANGE).cast("tinyint").alias("op"), "log_file", "log_pos", F.col("statement").alias("query"),
        *[F.lit(None).cast(kinds[c]).alias(c) for c in ("columns", "before", "after")],
    )
    return rows.unionByName(ddl).where(matches(f or Filter(), moment="event_at"))


def split_schema_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row changes, schema changes)."""
    return changes.where(F.col("op") != SCHEMA_CHANGE), changes.where(F.col("op") == SCHEMA_CHANGE)


def mark_read_only(changes: DataFrame, names: Iterable[str]) -> DataFrame:
    """Set read_only on columns named as column, table.column or schema.table.column."""
    wanted = sorted({n.strip().lower() for n in names if n.strip()})
    if not wanted:
        return changes

    def mark(c: Column) -> Column:
        bare = F.lower(c["name"])
        in_table = F.concat(F.lower("table_name"), F.lit("."), bare)
        full = F.concat(F.lower("schema_name"), F.lit("."), in_table)
        hit = bare.isin(wanted) | in_table.isin(wanted) | full.isin(wanted)
        return F.struct(c["name"].alias("name"), c["primary_key"].alias("primary_key"), (c["read_only"] | hit).alias("read_only"))

    return changes.withColumn("columns", F.transform("columns", mark))


def mark_generated(changes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Set read_only from a catalogue of (schema_name, table_name, column_name).

    Schema and table match exactly, the column in any case.  One row for each table is
    joined, so the catalogue is as small as the number of tables.
    """
    known = catalogue.groupBy("schema_name", "table_name").agg(F.collect_set(F.lower("column_name")).alias("__generated"))
    marked = changes.join(known, ["schema_name", "table_name"], "left")
    hit = lambda c: F.coalesce(F.array_contains("__generated", F.lower(c["name"])), F.lit(False))
    columns = F.transform(
        "columns",
        lambda c: F.struct(c["name"].alias("name"), c["primary_key"].alias("primary_key"), (c["read_only"] | hit(c)).alias("read_only")),
    )
    return marked.withColumn("columns", columns).select(*changes.columns)
