"""One query for each operator over the derived change log, and its SQL for DuckDB."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.moments import rfc3339_column
from ..functions.predicates import Filter, is_ddl, matches, safe_to_quote, valid_raw
from ..functions.values import comment_safe, float_text, literal
from ..model import SCHEMA_CHANGE, bytes_cell, op_name, time_cell
from ..operators.assemble import assemble
from ..operators.normalise import explode_images, file_changes, mark_generated, mark_read_only, op_of, refusal_of_event, split_schema_changes, with_positions
from ..operators.reverse import plan, with_statements
from ..operators.timeline import detail, timeline
from ..sources.fixture import FLAT_SQL, changes, flat_changes, lift
from ..sources.server import REQUIRED, failing_settings
from ..streaming.collector import Collector, read_stream
from .coverage import RETENTION, containing, is_stale, overlapping
from .script import block, schema_change_lines, script_frame
from .store import ChangeStore, undelivered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, *, flat: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = (f"WITH {FLAT_SQL}\n" if flat else "") + sql
        return f

    return add


_T = "'`shop`.`' || table_name || '`'"
_QUOTED = "'''' || {} || ''''"


def _statements(df: DataFrame) -> DataFrame:
    return with_statements(df).where("statement is not null").select("change_id", "statement")


_INSERTED = f"'DELETE FROM ' || {_T} || ' WHERE `id` = ' || id || ' LIMIT 1;'"
_SETS = "concat_ws(', ', CASE WHEN b_status <> a_status THEN '`status` = ''' || b_status || '''' END, CASE WHEN b_total <> a_total THEN '`total` = ' || b_total END)"
_UPDATED = f"'UPDATE ' || {_T} || ' SET ' || {_SETS} || ' WHERE `id` = ' || id || ' LIMIT 1;'"
_DELETED = f"'INSERT INTO ' || {_T} || ' (`id`, `status`, `total`) VALUES (' || id || ', ''' || b_status || ''', ' || b_total || ');'"
_ANY = f"CASE op WHEN 1 THEN {_INSERTED} WHEN 2 THEN {_UPDATED} WHEN 3 THEN {_DELETED} END"


@query(f"SELECT change_id, {_INSERTED} AS statement FROM c WHERE op = 1")
def reverse_insert(spark, sf_dir):
    return _statements(changes(spark, sf_dir).where("op = 1"))


@query(f"SELECT change_id, {_UPDATED} AS statement FROM c WHERE op = 2")
def reverse_update(spark, sf_dir):
    return _statements(changes(spark, sf_dir).where("op = 2"))


@query(f"SELECT change_id, {_DELETED} AS statement FROM c WHERE op = 3")
def reverse_delete(spark, sf_dir):
    return _statements(changes(spark, sf_dir).where("op = 3"))


@query(f"SELECT change_id, {_ANY} AS statement FROM c ORDER BY change_id DESC")
def reverse_plan_newest_first(spark, sf_dir):
    return plan(changes(spark, sf_dir)).select("change_id", "statement")


_WHERE_ALL = "'`id` = ' || id || ' AND `status` = ''' || a_status || ''' AND `total` = ' || a_total"


@query(f"""SELECT change_id, CASE op WHEN 1 THEN 'DELETE FROM ' || {_T} || ' WHERE ' || {_WHERE_ALL} || ' LIMIT 1;'
  WHEN 2 THEN 'UPDATE ' || {_T} || ' SET ' || {_SETS} || ' WHERE ' || {_WHERE_ALL} || ' LIMIT 1;' ELSE {_DELETED} END AS statement FROM c""")
def reverse_no_pk_where(spark, sf_dir):
    return _statements(changes(spark, sf_dir, key=()))


@query(f"""SELECT change_id, 'UPDATE ' || {_T} || ' SET ' || concat_ws(', ', CASE WHEN change_id % 11 = 0 THEN '`id` = ' || id END, {_SETS}) ||
  ' WHERE `id` = ' || (id + CASE WHEN change_id % 11 = 0 THEN 1000000 ELSE 0 END) || ' LIMIT 1;' AS statement FROM c WHERE op = 2""")
def reverse_pk_change(spark, sf_dir):
    moved = F.col("id") + F.when((F.col("op") == 2) & (F.col("change_id") % 11 == 0), 1_000_000).otherwise(0)
    return _statements(lift(flat_changes(spark, sf_dir), a_id=moved).where("op = 2"))


_NULLED = "CASE WHEN change_id % 13 = 0 THEN NULL ELSE {} END"


@query(f"""SELECT change_id, CASE op WHEN 1 THEN 'DELETE FROM ' || {_T} || ' WHERE `id` = ' || id || ' AND `status` = ''' || a_status || ''' AND `total`' || coalesce(' = ' || t, ' IS NULL') || ' LIMIT 1;'
  WHEN 3 THEN 'INSERT INTO ' || {_T} || ' (`id`, `status`, `total`) VALUES (' || id || ', ''' || b_status || ''', ' || coalesce(CAST(b AS VARCHAR), 'NULL') || ');' END AS statement
FROM (SELECT *, {_NULLED.format('a_total')} AS t, {_NULLED.format('b_total')} AS b FROM c) WHERE op <> 2""")
def reverse_null_is_null(spark, sf_dir):
    flat = flat_changes(spark, sf_dir)
    for name in ("a_total", "b_total"):
        flat = flat.withColumn(name, F.when(F.col("change_id") % 13 != 0, F.col(name)))
    return _statements(lift(flat, key=()).where("op <> 2"))


@query(f"""SELECT change_id, CASE WHEN table_name = 'accounts' AND b_status = a_status THEN NULL
  WHEN table_name = 'accounts' THEN 'UPDATE ' || {_T} || ' SET `status` = ''' || b_status || ''' WHERE `id` = ' || id || ' LIMIT 1;' ELSE {_UPDATED} END AS statement,
  table_name = 'accounts' AND b_status = a_status AS refused FROM c WHERE op = 2""")
def readonly_columns(spark, sf_dir):
    marked = mark_read_only(changes(spark, sf_dir).where("op = 2"), ["Accounts.Total", " "])
    return with_statements(marked).select("change_id", "statement", F.col("refusal").isNotNull().alias("refused"))


@query(f"""SELECT change_id, CASE WHEN table_name = 'wallets' THEN 'INSERT INTO ' || {_T} || ' (`id`, `status`) VALUES (' || id || ', ''' || b_status || ''');' ELSE {_DELETED} END AS statement
FROM c WHERE op = 3""")
def generated_columns(spark, sf_dir):
    catalogue = spark.createDataFrame([("shop", "wallets", "TOTAL"), ("other", "accounts", "total")], "schema_name string, table_name string, column_name string")
    return _statements(mark_generated(changes(spark, sf_dir).where("op = 3"), catalogue))


_LITERAL = r"CASE WHEN regexp_matches({0}, '[\x00-\x1f\x7f\\]') THEN 'X''' || hex(encode({0})) || '''' ELSE '''' || replace({0}, '''', '''''') || '''' END"


@query(f"SELECT doc_id, md5({_LITERAL.format('text')}) AS literal_md5, NOT regexp_matches(text, '[\\x00-\\x1f\\x7f\\\\]') AS quotable FROM documents", flat=False)
def literal_text_or_hex(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    return docs.select("doc_id", F.md5(literal(bytes_cell(F.col("raw"))).cast("binary")).alias("literal_md5"), safe_to_quote(F.col("raw")).alias("quotable"))


@query("SELECT event_id, '''' || strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '''' AS literal FROM events", flat=False)
def literal_time(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", literal(time_cell(F.col("ts").cast("timestamp"))).alias("literal"))


@query("SELECT event_id, regexp_replace(CAST(round(value, 3) AS VARCHAR), '[.]0$', '') AS shown FROM events", flat=False)
def literal_float(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", float_text(F.round("value", 3), "double").alias("shown"))


_MIXED = "CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'e5' WHEN 2 THEN ' ' WHEN 3 THEN '.' ELSE chr(10) END"


@query(f"SELECT event_id, regexp_full_match({_MIXED}, '[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?') AS fine, regexp_full_match(event_type, '[+-]?[0-9]+') AS word FROM events", flat=False)
def valid_raw_numbers(spark, sf_dir):
    tail = F.element_at(F.array(F.lit(""), F.lit("e5"), F.lit(" "), F.lit("."), F.lit("\n")), (F.col("event_id") % 5 + 1).cast("int"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", valid_raw(F.concat(F.col("value").cast("decimal(18,2)").cast("string"), tail)).alias("fine"), valid_raw(F.col("event_type")).alias("word"))


@query("""SELECT change_id, CASE WHEN op IN (2, 3) THEN concat_ws('|', id, b_status, b_total) END AS before_text,
  CASE WHEN op IN (1, 2) THEN concat_ws('|', id, a_status, a_total) END AS after_text FROM c""")
def display_values(spark, sf_dir):
    shown = detail(changes(spark, sf_dir))
    return shown.select(F.col("id").alias("change_id"), F.array_join("before", "|").alias("before_text"), F.array_join("after", "|").alias("after_text"))


@query("SELECT change_id FROM c WHERE table_name = 'wallets'")
def filter_table(spark, sf_dir):
    return changes(spark, sf_dir).where(matches(Filter(("SHOP.Wallets", "nothing")))).select("change_id")


_START, _END = datetime(2024, 1, 5, tzinfo=UTC), datetime(2024, 1, 12, 12, 30, tzinfo=UTC)


@query("SELECT change_id, strftime(ev_at, '%Y-%m-%dT%H:%M:%SZ') AS moment FROM c WHERE ev_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:30:00'")
def filter_window_inclusive(spark, sf_dir):
    found = changes(spark, sf_dir).where(matches(Filter((), _START, _END)))
    return found.select("change_id", rfc3339_column(F.col("committed_at")).alias("moment"))


def _with_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    ddl = F.col("change_id") % 997 == 0
    out = changes(spark, sf_dir).withColumn("query", F.when(ddl, F.lit("ALTER TABLE t ADD COLUMN x INT")).otherwise(F.col("query")))
    return out.withColumn("op", F.when(ddl, F.lit(SCHEMA_CHANGE)).otherwise(F.col("op")).cast("tinyint"))


@query("SELECT change_id, change_id % 997 = 0 AS schema_change FROM c WHERE (table_name = 'wallets' OR change_id % 997 = 0) AND ev_at <= TIMESTAMP '2024-01-12 12:30:00'")
def filter_schema_change_bypass(spark, sf_dir):
    found = _with_ddl(spark, sf_dir).where(matches(Filter(("wallets",), None, _END)))
    return found.select("change_id", (F.col("op") == SCHEMA_CHANGE).alias("schema_change"))


@query("SELECT CASE WHEN change_id % 997 = 0 THEN 'schema' ELSE 'row' END AS kind, count(*) AS n FROM c GROUP BY 1")
def split_changes(spark, sf_dir):
    rows, ddl = split_schema_changes(_with_ddl(spark, sf_dir))
    return rows.select(F.lit("row").alias("kind")).unionByName(ddl.select(F.lit("schema").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_STATEMENTS = ("ALTER TABLE x ADD y INT", "  create index i ON x (y)", "BEGIN", "", "dropx", "TRUNCATE t", "UPDATE t SET a = 1")


@query(f"SELECT event_id, regexp_matches(upper(ltrim(s)), '^(ALTER|CREATE|DROP|RENAME|TRUNCATE) ') AS ddl FROM (SELECT event_id, ({list(_STATEMENTS)!r})[1 + event_id % 7] AS s FROM events)", flat=False)
def is_ddl_statement(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(s) for s in _STATEMENTS]), (F.col("event_id") % 7 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", is_ddl(said).alias("ddl"))


_SUMMARY = """change_id AS id, strftime(ev_at, '%Y-%m-%dT%H:%M:%SZ') AS moment, schema_name AS "schema", table_name AS "table",
  CASE op WHEN 1 THEN 'INSERT' WHEN 2 THEN 'UPDATE' ELSE 'DELETE' END AS op, log_file, log_pos, CASE WHEN change_id % 5 = 0 THEN '' ELSE 'UPDATE row ' || id END AS query, false AS schema_change"""


@query(f"SELECT {_SUMMARY} FROM c ORDER BY change_id DESC LIMIT 100")
def timeline_page1(spark, sf_dir):
    return timeline(changes(spark, sf_dir).orderBy(F.col("change_id").desc()).limit(100))


@query(f"SELECT {_SUMMARY} FROM c WHERE table_name = 'wallets' AND change_id < 5000 ORDER BY change_id DESC LIMIT 50")
def timeline_page_cursor(spark, sf_dir):
    found = changes(spark, sf_dir).where(matches(Filter(("wallets",))) & (F.col("change_id") < 5000))
    return timeline(found.orderBy(F.col("change_id").desc()).limit(50))


@query(f"SELECT {_SUMMARY} FROM c")
def timeline_walk(spark, sf_dir):
    return timeline(changes(spark, sf_dir))


@query("SELECT change_id, CASE op WHEN 1 THEN 'INSERT' WHEN 2 THEN 'UPDATE' WHEN 3 THEN 'DELETE' END AS name FROM c")
def operation_names(spark, sf_dir):
    return changes(spark, sf_dir).select("change_id", op_name(F.col("op")).alias("name"))


@query("""SELECT change_id, 3::BIGINT AS n_columns, CASE WHEN op IN (2,3) THEN 3::BIGINT ELSE -1 END AS n_before, CASE WHEN op IN (1,2) THEN 3::BIGINT ELSE -1 END AS n_after FROM c""")
def detail_images(spark, sf_dir):
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(-1).cast("long")
    return detail(changes(spark, sf_dir)).select(F.col("id").alias("change_id"), n("columns").alias("n_columns"), n("before").alias("n_before"), n("after").alias("n_after"))


def decoded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log as decoded events: GTID (two in three), BEGIN, statement and rows of
    each change, then XID or (every 17th transaction) ROLLBACK."""
    rows = changes(spark, sf_dir).withColumn("stream", F.lit("s1"))
    image = F.filter(F.array("before", "after"), lambda x: x.isNotNull())
    kind = F.element_at(F.array(F.lit("WRITE_ROWS_V2"), F.lit("UPDATE_ROWS_V1"), F.lit("DELETE_ROWS_COMPRESSED_V1")), F.col("op").cast("int"))
    base = ["stream", F.lit(0).alias("file_ord"), "log_file", F.col("committed_at").alias("event_at"), "server_id"]
    none = lambda t: F.lit(None).cast(t)
    images_type = f"array<{rows.schema['before'].dataType.simpleString()}>"

    def control(df: DataFrame, order, event_type, pos, statement=None, gtid=None) -> DataFrame:
        return df.select(
            *base, order.cast("long").alias("event_ord"), event_type.alias("event_type"), pos.cast("long").alias("log_pos"), F.lit(50).cast("long").alias("event_size"),
            none("string").alias("schema_name"), none("string").alias("table_name"), none("array<string>").alias("names"), none("array<int>").alias("pk"),
            none("array<array<int>>").alias("skipped"), none(images_type).alias("images"), (none("string") if statement is None else statement).alias("statement"), (none("string") if gtid is None else gtid).alias("gtid"),
        )

    c = F.col("change_id")
    row_events = rows.select(
        *base, (c * 10 + 5).alias("event_ord"), kind.alias("event_type"), "log_pos", F.lit(80).cast("long").alias("event_size"), "schema_name", "table_name",
        F.transform("columns", lambda x: x["name"]).alias("names"), F.array(F.lit(0)).alias("pk"), none("array<array<int>>").alias("skipped"), image.alias("images"), none("string").alias("statement"), none("string").alias("gtid"),
    )
    said = control(rows.where("query is not null"), c * 10 + 4, F.lit("ROWS_QUERY"), F.lit(0), F.col("query"))
    txns = rows.groupBy("stream", "txn_id", "log_file").agg(
        F.min("change_id").alias("a"), F.max("change_id").alias("b"), F.max("log_pos").alias("p"), F.max("committed_at").alias("committed_at"), F.max("server_id").alias("server_id")
    )
    t = F.col("txn_id")
    gtid = control(txns.where(t % 3 != 0), F.col("a") * 10 + 1, F.lit("GTID"), F.lit(0), gtid=F.concat(F.lit("gtid:"), t.cast("string")))
    begin = control(txns, F.col("a") * 10 + 2, F.lit("QUERY"), F.lit(0), F.lit("BEGIN"))
    undone = t % 17 == 0
    end = control(txns, F.col("b") * 10 + 9, F.when(undone, F.lit("QUERY")).otherwise(F.lit("XID")), F.col("p") + 9, F.when(undone, F.lit("ROLLBACK")))
    return row_events.unionByName(said).unionByName(gtid).unionByName(begin).unionByName(end)


_TXN = """t AS (SELECT txn_id, log_file, max(log_pos) + 9 AS pos, max(change_id) AS last_id FROM c GROUP BY txn_id, log_file)"""
_SOURCE = "CASE WHEN t.txn_id % 3 <> 0 THEN 'gtid:' || t.txn_id ELSE t.log_file || ':' || t.pos END"


@query(f""", {_TXN} SELECT change_id, {_SOURCE} AS source_txn_id, CAST(op AS INT) AS op, strftime(l.at2, '%Y-%m-%d %H:%M:%S') AS committed_at
FROM c JOIN t USING (txn_id) JOIN (SELECT change_id AS last_id, ev_at AS at2 FROM c) l USING (last_id) WHERE txn_id % 17 <> 0""")
def txn_assembly(spark, sf_dir):
    found = assemble(decoded_events(spark, sf_dir)).changes
    return found.select(
        F.floor(F.col("event_ord") / 10).cast("long").alias("change_id"), "source_txn_id", F.col("op").cast("int").alias("op"), F.date_format("committed_at", "yyyy-MM-dd HH:mm:ss").alias("committed_at")
    )


@query(f""", {_TXN} SELECT {_SOURCE} AS source_txn_id, count(*) AS n FROM c JOIN t USING (txn_id) WHERE txn_id % 17 <> 0 GROUP BY 1""")
def source_txn_id(spark, sf_dir):
    return assemble(decoded_events(spark, sf_dir)).changes.groupBy("source_txn_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS kept, count(DISTINCT txn_id) AS txns FROM c WHERE txn_id % 17 <> 0")
def txn_rollback_discard(spark, sf_dir):
    found = assemble(decoded_events(spark, sf_dir)).changes
    return found.agg(F.count(F.lit(1)).alias("kept"), F.count_distinct("source_txn_id").alias("txns"))


@query("SELECT change_id, CASE WHEN change_id % 5 <> 0 THEN 'UPDATE row ' || id END AS query FROM c WHERE txn_id % 17 <> 0")
def query_attach(spark, sf_dir):
    return assemble(decoded_events(spark, sf_dir)).changes.select(F.floor(F.col("event_ord") / 10).cast("long").alias("change_id"), "query")


@query("SELECT change_id, CAST(4 + sum(100 + change_id % 7) OVER (PARTITION BY log_file ORDER BY change_id) AS BIGINT) AS log_pos FROM c WHERE change_id % 2 = 0 UNION ALL SELECT change_id, log_pos FROM c WHERE change_id % 2 = 1")
def position_reconstruct(spark, sf_dir):
    flat = flat_changes(spark, sf_dir).withColumn("event_size", F.when(F.col("change_id") % 2 == 0, F.col("change_id") % 7 + 100).otherwise(F.lit(0)))
    placed = with_positions(flat.withColumn("log_pos", F.when(F.col("change_id") % 2 == 0, F.lit(0)).otherwise(F.col("log_pos"))), order="change_id")
    return placed.select("change_id", "log_pos")


@query("SELECT change_id, row_ord, a_status, b_status FROM (SELECT change_id, 0 AS row_ord, a_status, b_status FROM c UNION ALL SELECT change_id, 1, a_status, b_status FROM c WHERE op = 2)")
def update_pairs(spark, sf_dir):
    rows = decoded_events(spark, sf_dir).where(op_of(F.col("event_type")).isNotNull())
    twice = rows.withColumn("images", F.when(op_of(F.col("event_type")) == 2, F.concat("images", "images")).otherwise(F.col("images")))
    status = lambda image: F.get(F.col(image), F.lit(1))["bin"].cast("string")
    return explode_images(twice).select(F.floor(F.col("event_ord") / 10).cast("long").alias("change_id"), "row_ord", status("after").alias("a_status"), status("before").alias("b_status"))


@query("SELECT count(*) AS n, count(*) FILTER (change_id % 7 = 0 OR change_id % 10 = 3 OR (op = 2 AND change_id % 10 = 4)) AS refused FROM c")
def event_refusals(spark, sf_dir):
    c = F.floor(F.col("event_ord") / 10)
    rows = decoded_events(spark, sf_dir).where(op_of(F.col("event_type")).isNotNull())
    rows = rows.withColumn("skipped", F.when(c % 7 == 0, F.array(F.array(F.lit(1)))).otherwise(F.col("skipped")))
    rows = rows.withColumn("pk", F.when(c % 10 == 3, F.array(F.lit(9))).otherwise(F.col("pk")))
    rows = rows.withColumn("images", F.when((op_of(F.col("event_type")) == 2) & (c % 10 == 4), F.slice("images", 1, 1)).otherwise(F.col("images")))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count(refusal_of_event()).alias("refused"))


@query("SELECT change_id, txn_id FROM c WHERE txn_id % 10 <> 0")
def dedup_redelivery(spark, sf_dir):
    all_changes = changes(spark, sf_dir).withColumn("is_ddl", F.lit(False))
    delivered = all_changes.unionByName(all_changes.where("txn_id % 50 = 1"))
    stored = all_changes.where("txn_id % 10 = 0").select("source_txn_id", "is_ddl").distinct()
    return undelivered(delivered, stored, ["change_id"]).select("change_id", "txn_id")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).groupBy(F.date_format("committed_at", "yyyy-MM-dd HH").alias("hour")).agg(F.min("committed_at").alias("start"), F.max("committed_at").alias("end"))


_WINDOWS = "w AS (SELECT strftime(ev_at, '%Y-%m-%d %H') AS hour, min(ev_at) AS a, max(ev_at) AS b FROM c GROUP BY 1)"


@query(f", {_WINDOWS} SELECT hour FROM w WHERE a <= TIMESTAMP '2024-01-10 06:00:00' AND b >= TIMESTAMP '2024-01-10 00:00:00'")
def gap_overlap(spark, sf_dir):
    gaps = spark.createDataFrame([(datetime(2024, 1, 10, tzinfo=UTC), datetime(2024, 1, 10, 6, tzinfo=UTC))], "start timestamp, end timestamp")
    return overlapping(_windows(spark, sf_dir), gaps).select("hour")


@query(f", {_WINDOWS} SELECT hour FROM w WHERE TIMESTAMP '2024-01-20 12:00:00' BETWEEN date_trunc('hour', a) AND b")
def miss_in_window(spark, sf_dir):
    misses = spark.createDataFrame([(datetime(2024, 1, 20, 12, tzinfo=UTC),)], "moment timestamp")
    return containing(_windows(spark, sf_dir).withColumn("start", F.date_trunc("hour", "start")), misses).select("hour")


@query("SELECT change_id, epoch(ts2) - epoch(ev_at) > 300 AS stale FROM (SELECT change_id, ev_at, lead(ev_at) OVER (PARTITION BY id ORDER BY change_id) AS ts2 FROM c) WHERE ts2 IS NOT NULL")
def staleness(spark, sf_dir):
    from pyspark.sql import Window

    flat = flat_changes(spark, sf_dir).withColumn("later", F.lead("ev_at").over(Window.partitionBy("id").orderBy("change_id")))
    return flat.where("later is not null").select("change_id", is_stale(F.col("ev_at"), F.col("later"), 300).alias("stale"))


_BLOCK = f"""concat_ws(chr(10), '', '-- undo ' || CASE op WHEN 1 THEN 'INSERT' WHEN 2 THEN 'UPDATE' ELSE 'DELETE' END || ' shop.' || table_name || ' — ' || log_file || ':' || log_pos ||
  ' at ' || strftime(ev_at, '%Y-%m-%d %H:%M:%S') || ' UTC', CASE WHEN change_id % 5 <> 0 THEN '-- caused by: UPDATE row ' || id END, {_ANY})"""


@query(f"SELECT change_id, {_BLOCK} AS block FROM c")
def script_blocks(spark, sf_dir):
    return plan(changes(spark, sf_dir)).select("change_id", block().alias("block"))


@query("SELECT '--   ' || strftime(ev_at, '%Y-%m-%d %H:%M:%S') || ' UTC at ' || log_file || ':' || log_pos || ' — ALTER TABLE t ADD COLUMN x INT' AS line FROM c WHERE change_id % 997 = 0")
def ddl_warning(spark, sf_dir):
    return schema_change_lines(_with_ddl(spark, sf_dir))


@query("SELECT count(*) AS statements, '-- end of script: ' || count(*) || ' statements' AS trailer FROM c WHERE table_name = 'wallets' AND ev_at <= TIMESTAMP '2024-01-12 12:30:00'")
def script_count(spark, sf_dir):
    f = Filter(("wallets",), None, _END)
    found = with_statements(changes(spark, sf_dir).where(matches(f))).where("statement is not null")
    return found.agg(F.count("statement").alias("statements")).withColumn("trailer", F.concat(F.lit("-- end of script: "), F.col("statements"), F.lit(" statements")))


@query(f"""SELECT line FROM (SELECT unnest(string_split({_BLOCK}, chr(10))) AS line FROM c)
UNION ALL SELECT unnest(['-- rowtide revert script', '-- source: fixture', '-- newest change first', '-- REVIEW BEFORE RUNNING — nothing here has been executed.', '', 'SET time_zone = ''+00:00'';', 'SET NAMES utf8mb4;', ''])
UNION ALL SELECT '-- end of script: ' || count(*) || ' statements' FROM c""")
def script_text(spark, sf_dir):
    return script_frame(changes(spark, sf_dir), "fixture").select("line")


def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        warnings.warn("spark.checkpoint.dir is not set; using a folder of this machine, which no cluster shares", stacklevel=2)
        shared = tempfile.mkdtemp(prefix="rowtide-store-")
    return f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}"


def recorded(spark: SparkSession, sf_dir: str) -> ChangeStore:
    """A store that got the log in two deliveries which overlap."""
    store = ChangeStore(spark, _scratch(spark))
    rows = changes(spark, sf_dir).withColumn("ord", F.col("change_id"))
    store.append(rows.where("txn_id % 10 < 6"), order=["ord"], batch=("fixture", 0))
    store.append(rows.where("txn_id % 10 > 3"), order=["ord"], batch=("fixture", 1))
    return store


_STORED = """, s AS (SELECT *, row_number() OVER (ORDER BY txn_id % 10 > 5, txn_id, change_id) AS stored_id FROM c)"""


@query(_STORED + " SELECT stored_id AS change_id, 'fixture:' || txn_id AS source_txn_id, table_name, CAST(op AS INT) AS op, log_pos FROM s")
def store_scan(spark, sf_dir):
    found = recorded(spark, sf_dir).snapshot().changes()
    return found.select("change_id", "source_txn_id", "table_name", F.col("op").cast("int").alias("op"), "log_pos")


@query(_STORED + " SELECT stored_id AS change_id, log_pos FROM s WHERE table_name = 'wallets' AND stored_id < 400 ORDER BY stored_id DESC LIMIT 25")
def store_page(spark, sf_dir):
    snapshot = recorded(spark, sf_dir).snapshot()
    return snapshot.page(Filter(("wallets",)), 400, 25, snapshot.coverage.end).select("change_id", "log_pos")


@query(_STORED + " SELECT stored_id AS change_id, txn_id, log_file, log_pos FROM s WHERE stored_id = 5")
def change_lookup(spark, sf_dir):
    found = recorded(spark, sf_dir).snapshot().change(5)
    return found.select("change_id", F.split("source_txn_id", ":")[1].cast("long").alias("txn_id"), "log_file", "log_pos")


@query(", m AS (SELECT txn_id, max(ev_at) AS last_at FROM c GROUP BY txn_id) SELECT 'fixture:' || txn_id AS source_txn_id, log_pos FROM c JOIN m USING (txn_id) WHERE last_at >= (SELECT max(ev_at) FROM c) - INTERVAL 7 DAY")
def store_prune(spark, sf_dir):
    store = recorded(spark, sf_dir)
    store.set_retention(RETENTION)
    store.prune(store.snapshot().coverage.end)
    return store.snapshot().changes().select("source_txn_id", "log_pos")


@query("SELECT change_id, CAST(op AS INT) AS op, log_pos FROM c WHERE table_name = 'accounts'")
def file_scan(spark, sf_dir):
    found = file_changes(decoded_events(spark, sf_dir), Filter(("accounts",)))
    return found.select(F.floor(F.col("event_ord") / 10).cast("long").alias("change_id"), F.col("op").cast("int").alias("op"), "log_pos")


@query(f", {_TXN} SELECT {_SOURCE} AS source_txn_id, log_pos FROM c JOIN t USING (txn_id, log_file) WHERE txn_id % 17 <> 0")
def stream_collect(spark, sf_dir):
    """The log as JSON lines files, collected by a streaming query into a store."""
    base = _scratch(spark)
    decoded_events(spark, sf_dir).withColumn("sub_ord", F.lit(0)).repartitionByRange(2, "event_ord").write.json(f"{base}/log")
    collector = Collector(ChangeStore(spark, f"{base}/store"))
    collector.start(read_stream(spark, f"{base}/log"), f"{base}/stream").awaitTermination()
    return collector.store.snapshot().changes().select("source_txn_id", "log_pos")


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(replace(text, ' ', ''), '[\p{C}\p{Z}]') THEN '<unprintable, ' || strlen(text) || CASE strlen(text) WHEN 1 THEN ' byte>' ELSE ' bytes>' END
  WHEN strlen(text) <= 200 THEN text ELSE left(text, list_max(list_filter(range(0, 201), lambda k: strlen(left(text, k)) <= 200))) || '… <truncated, ' || strlen(text) || ' bytes total>' END AS shown FROM documents""", flat=False)
def comment_safe_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", comment_safe(F.encode("text", "UTF-8")).alias("shown"))


@query("SELECT name, want FROM (VALUES ('binlog_row_image', 'FULL'), ('binlog_row_metadata', 'FULL')) v(name, want)", flat=False)
def required_settings(spark, sf_dir):
    assert len(REQUIRED) == 3
    reported = spark.createDataFrame([("binlog_format", "row"), ("binlog_row_image", "MINIMAL")], "name string, value string")
    return failing_settings(reported)


from . import store_queries  # noqa: E402, F401  (adds its queries to the tables above)
