"""Checks on the server a log comes from, over its reported variables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Refused
from ..plans.coverage import Binding
from .decoded_log import DecodeOptions

MYSQL, MARIADB = "mysql", "mariadb"
DEFAULT_PORT = "3306"
# Settings without which a reversal would be wrong.
REQUIRED = (
    ("binlog_format", "ROW", "statement logs hold no rows to reverse"),
    ("binlog_row_image", "FULL", "partial images omit the values that a reversal restores"),
    ("binlog_row_metadata", "FULL", "without column names a reversal would be a guess"),
)


def check_settings(variables: dict[str, str]) -> None:
    """Refuse a server whose log cannot be reversed."""
    for name, want, why in REQUIRED:
        if name not in variables:
            raise Refused(f"the server does not report {name}; it must be {want}: {why}")
        if variables[name].upper() != want:
            raise Refused(f"{name} is {variables[name]}, must be {want}: {why}")
    options = variables.get("binlog_row_value_options", "")
    if "PARTIAL_JSON" in options.upper():
        raise Refused(f"binlog_row_value_options is {options}: JSON columns are logged as differences, which reverse to wrong documents")


def failing_settings(variables: DataFrame) -> DataFrame:
    """The required settings that ``variables`` (name, value) lacks, as an anti join."""
    required = variables.sparkSession.createDataFrame([(n, w) for n, w, _ in REQUIRED], "name string, want string")
    same = (required["name"] == variables["name"]) & (F.upper(variables["value"]) == required["want"])
    return required.join(variables, same, "left_anti")


def flavor_of(version: str) -> str:
    return MARIADB if "mariadb" in version.lower() else MYSQL


def statement_capture(flavor: str, variables: dict[str, str]) -> bool:
    name = "binlog_annotate_row_events" if flavor == MARIADB else "binlog_rows_query_log_events"
    return variables.get(name, "").upper() == "ON"


def identity(flavor: str, variables: dict[str, str]) -> tuple[str, str]:
    """(what names this server, GTID dialect or nothing)."""
    if flavor == MARIADB:
        if not variables.get("server_id"):
            raise Refused("the server does not report server_id, so a store cannot be bound to it")
        return f"mariadb:{variables.get('gtid_domain_id', '')}:{variables['server_id']}", "mariadb"
    if not variables.get("server_uuid"):
        raise Refused("the server does not report server_uuid, so a store cannot be bound to it")
    mode = variables.get("gtid_mode", "").upper()
    return f"mysql:{variables['server_uuid']}", "" if mode in ("", "OFF", "OFF_PERMISSIVE") else "mysql"


@dataclass
class ServerInfo:
    binding: Binding
    captures_statements: bool
    generated: DataFrame | None = field(default=None)


def preflight(version: str, variables: dict[str, str], options: DecodeOptions | None = None, generated: DataFrame | None = None) -> ServerInfo:
    """What a collector must know before it starts; a missing catalogue is no refusal."""
    check_settings(variables)
    flavor = flavor_of(version)
    name, dialect = identity(flavor, variables)
    return ServerInfo(Binding(flavor, name, dialect, (options or DecodeOptions()).fingerprint()), statement_capture(flavor, variables), generated)


def generated_columns(catalogue: DataFrame) -> DataFrame:
    """(schema_name, table_name, column_name) of computed columns out of a catalogue
    (TABLE_SCHEMA, TABLE_NAME, COLUMN_NAME, EXTRA)."""
    found = catalogue.where(F.upper("EXTRA").contains("GENERATED"))
    return found.select(F.col("TABLE_SCHEMA").alias("schema_name"), F.col("TABLE_NAME").alias("table_name"), F.col("COLUMN_NAME").alias("column_name"))


@dataclass(frozen=True)
class ConnectionString:
    user: str
    password: str = field(repr=False)
    address: str = ""

    @classmethod
    def parse(cls, text: str) -> ConnectionString:
        """``user:password@tcp(host:port)/database`` or ``user:password@host:port``; the
        last @ splits, the database is ignored.  No message carries the password."""
        shape = "expected user:password@tcp(host:3306)/"
        text = text.strip()
        if not text:
            raise Refused(f"no connection string given; {shape}")
        credentials, at, rest = text.rpartition("@")
        if not at:
            raise Refused(f"the connection string has no @ between credentials and host; {shape}")
        user, _, password = credentials.partition(":")
        if not user:
            raise Refused(f"the connection string names no user; {shape}")
        host = rest.partition("/")[0]
        if "(" in host:
            opened, closed = host.index("("), host.rfind(")")
            if closed < opened:
                raise Refused(f"the connection string has an unclosed ( in the host; {shape}")
            host = host[opened + 1 : closed]
        host = host.strip()
        if not host:
            raise Refused(f"the connection string names no host; {shape}")
        return cls(user, password, host if ":" in host else f"{host}:{DEFAULT_PORT}")


def redact(text: str) -> str:
    """The connection string without its password."""
    credentials, at, host = text.rpartition("@")
    if not at:
        return text
    user, colon, _ = credentials.partition(":")
    return f"{user}:***@{host}" if colon else f"{credentials}@{host}"
