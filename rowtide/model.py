"""The data model: row changes, their typed cells and the frames that hold them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSERT, UPDATE, DELETE, SCHEMA_CHANGE = 1, 2, 3, 4
OP_NAMES = {INSERT: "INSERT", UPDATE: "UPDATE", DELETE: "DELETE", SCHEMA_CHANGE: "SCHEMA CHANGE"}

# Tags of a cell; SQL NULL is a null cell, without a tag.
INT, UINT, FLOAT32, FLOAT64, BOOL, STRING, BYTES, TIME, RAW = range(1, 10)

CELL = T.StructType(
    [
        T.StructField("tag", T.ByteType()),
        T.StructField("i", T.LongType()),
        T.StructField("u", T.DecimalType(20, 0)),
        T.StructField("f", T.FloatType()),
        T.StructField("d", T.DoubleType()),
        T.StructField("b", T.BooleanType()),
        T.StructField("bin", T.BinaryType()),
        T.StructField("t", T.TimestampType()),
        T.StructField("raw", T.StringType()),
    ]
)
IMAGE = T.ArrayType(CELL)
COLUMNS = T.ArrayType(
    T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("primary_key", T.BooleanType()),
            T.StructField("read_only", T.BooleanType()),
        ]
    )
)
CHANGE = T.StructType(
    [
        T.StructField("change_id", T.LongType()),
        T.StructField("txn_id", T.LongType()),
        T.StructField("source_txn_id", T.StringType()),
        T.StructField("committed_at", T.TimestampType()),
        T.StructField("server_id", T.LongType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("op", T.ByteType()),
        T.StructField("log_file", T.StringType()),
        T.StructField("log_pos", T.LongType()),
        T.StructField("query", T.StringType()),
        T.StructField("columns", COLUMNS),
        T.StructField("before", IMAGE),
        T.StructField("after", IMAGE),
    ]
)
CHANGE_COLUMNS = CHANGE.fieldNames()


def op_name(op: Column) -> Column:
    """Name of an operation code; UNKNOWN for any other."""
    named = F.when(F.lit(False), F.lit(""))
    for code, name in OP_NAMES.items():
        named = named.when(op == code, F.lit(name))
    return named.otherwise(F.lit("UNKNOWN"))


def cell(tag: int, **value: Column) -> Column:
    """A cell of one kind, null where its value is null."""
    fields = [F.lit(tag).cast("tinyint").alias("tag")]
    for field in CELL.fields[1:]:
        fields.append(value.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name))
    (given,) = value.values()
    return F.when(given.isNotNull(), F.struct(*fields)).otherwise(F.lit(None).cast(CELL))


def int_cell(x: Column) -> Column:
    return cell(INT, i=x)


def uint_cell(x: Column) -> Column:
    return cell(UINT, u=x)


def text_cell(x: Column) -> Column:
    return cell(STRING, bin=x.cast("binary"))


def bytes_cell(x: Column) -> Column:
    return cell(BYTES, bin=x)


def decimal_cell(x: Column) -> Column:
    """An exact decimal becomes its own text, scale included."""
    return cell(RAW, raw=x.cast("string"))


def time_cell(x: Column) -> Column:
    return cell(TIME, t=x)


def float_cell(x: Column) -> Column:
    return cell(FLOAT64, d=x)


def bool_cell(x: Column) -> Column:
    return cell(BOOL, b=x)


def row_image(*cells: Column) -> Column:
    return F.array(*cells)


def columns_of(*names: str, key: tuple[str, ...] = (), read_only: tuple[str, ...] = ()) -> Column:
    """A literal column list."""
    return F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(n in key).alias("primary_key"), F.lit(n in read_only).alias("read_only"))
            for n in names
        ]
    )
