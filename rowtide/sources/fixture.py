"""A deterministic change log derived from the ``events`` table.

Each user is a row whose (status, total) its events overwrite; ``error`` deletes the row
and the next other event inserts it again; an event that changes nothing logs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import CHANGE_COLUMNS, DELETE, IMAGE, INSERT, UPDATE, columns_of, decimal_cell, int_cell, row_image, text_cell


def flat_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """change_id, txn_id, log_file, log_pos, ev_at, schema_name, table_name, op, id, b_*, a_*."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", F.col("value").cast("decimal(18,2)").alias("v"))
    own = Window.partitionBy("user_id").orderBy("event_id")
    e = e.withColumn("p_type", F.lag("event_type").over(own)).withColumn("p_v", F.lag("v").over(own))
    gone, error = F.col("p_type").isNull() | (F.col("p_type") == "error"), F.col("event_type") == "error"
    op = F.when(gone, F.when(~error, F.lit(INSERT))).when(error, F.lit(DELETE)).when((F.col("p_type") != F.col("event_type")) | (F.col("p_v") != F.col("v")), F.lit(UPDATE))
    o = e.withColumn("op", op.cast("int")).where("op is not null")
    before, after = F.col("op").isin(UPDATE, DELETE), F.col("op").isin(INSERT, UPDATE)
    return o.select(
        F.col("event_id").alias("change_id"),
        F.floor(F.col("event_id") / 4).cast("long").alias("txn_id"),
        F.concat(F.lit("binlog.00000"), (F.floor(F.col("event_id") / 4000) + 1).cast("string")).alias("log_file"),
        (F.col("event_id") % 4000 * 100 + 4).cast("long").alias("log_pos"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ev_at"),
        F.lit("shop").alias("schema_name"),
        F.when(F.col("user_id") % 3 == 0, F.lit("wallets")).otherwise(F.lit("accounts")).alias("table_name"),
        "op",
        F.col("user_id").alias("id"),
        F.when(before, F.col("p_type")).alias("b_status"),
        F.when(before, F.col("p_v")).alias("b_total"),
        F.when(after, F.col("event_type")).alias("a_status"),
        F.when(after, F.col("v")).alias("a_total"),
    )


def lift(flat: DataFrame, *, key: tuple[str, ...] = ("id",), read_only: tuple[str, ...] = (), a_id: Column | None = None) -> DataFrame:
    """The flat form as changes with typed cells."""
    none = F.lit(None).cast(IMAGE)
    op = F.col("op")
    b = row_image(int_cell(F.col("id")), text_cell(F.col("b_status")), decimal_cell(F.col("b_total")))
    a = row_image(int_cell(F.col("id") if a_id is None else a_id), text_cell(F.col("a_status")), decimal_cell(F.col("a_total")))
    out = flat.select(
        "change_id", "txn_id", F.concat(F.lit("fixture:"), F.col("txn_id").cast("string")).alias("source_txn_id"), F.col("ev_at").alias("committed_at"),
        F.lit(17).cast("long").alias("server_id"), "schema_name", "table_name", op.cast("tinyint").alias("op"), "log_file", "log_pos",
        F.when(F.col("change_id") % 5 != 0, F.concat(F.lit("UPDATE row "), F.col("id").cast("string"))).alias("query"),
        columns_of("id", "status", "total", key=key, read_only=read_only).alias("columns"),
        F.when(op.isin(UPDATE, DELETE), b).otherwise(none).alias("before"), F.when(op.isin(INSERT, UPDATE), a).otherwise(none).alias("after"),
    )
    return out.select(*CHANGE_COLUMNS)


def changes(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return lift(flat_changes(spark, sf_dir), **options)


#: The flat form in DuckDB SQL.
FLAT_SQL = """e AS (
  SELECT event_id, ts, user_id, event_type, CAST(value AS DECIMAL(18,2)) AS v,
         LAG(event_type) OVER w AS p_type, LAG(CAST(value AS DECIMAL(18,2))) OVER w AS p_v
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
), o AS (
  SELECT *, CASE WHEN p_type IS NULL OR p_type = 'error' THEN CASE WHEN event_type <> 'error' THEN 1 END
                 WHEN event_type = 'error' THEN 3
                 WHEN p_type <> event_type OR p_v <> v THEN 2 END AS op FROM e
), c AS (
  SELECT event_id AS change_id, CAST(FLOOR(event_id / 4) AS BIGINT) AS txn_id,
         CONCAT('binlog.00000', CAST(1 + CAST(FLOOR(event_id / 4000) AS BIGINT) AS VARCHAR)) AS log_file,
         CAST(4 + (event_id % 4000) * 100 AS BIGINT) AS log_pos, CAST(DATE_TRUNC('second', ts) AS TIMESTAMP) AS ev_at,
         'shop' AS schema_name, CASE WHEN user_id % 3 = 0 THEN 'wallets' ELSE 'accounts' END AS table_name,
         CAST(op AS INT) AS op, user_id AS id,
         CASE WHEN op IN (2,3) THEN p_type END AS b_status, CASE WHEN op IN (2,3) THEN p_v END AS b_total,
         CASE WHEN op IN (1,2) THEN event_type END AS a_status, CASE WHEN op IN (1,2) THEN v END AS a_total
  FROM o WHERE op IS NOT NULL
)"""
