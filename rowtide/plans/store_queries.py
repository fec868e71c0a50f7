"""Queries over stores, collectors, scripts, sources and the facade, and their SQL.

Outcomes of small cases (what is refused, and by which rule) are rows too; their SQL states
the expected rows, or derives them from the cases by the rules themselves.
"""

from __future__ import annotations

import contextlib
import io
import itertools
import json
import os
import tempfile
from collections.abc import Callable, Iterable
from datetime import UTC, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..api import Api, is_loopback, serve
from ..functions.codec import decode_rows_udf, encode_rows_udf
from ..functions.moments import filter_from, parse_time, rfc3339, split_list, whole_number
from ..functions.predicates import BadRequest, Filter, Refused, matches
from ..model import SCHEMA_CHANGE
from ..operators.assemble import assemble
from ..operators.normalise import op_of
from ..operators.reverse import with_statements
from ..operators.timeline import page
from ..sources.decoded_log import DecodeOptions, read_changes
from ..sources.fixture import changes
from ..sources.server import ConnectionString, check_settings, flavor_of, generated_columns, identity, preflight, redact, statement_capture
from ..streaming.collector import Collector
from .claim import Claim
from .coverage import RETENTION, Binding, Coverage, Gap, Miss, ahead, check, earliest, highest, rowless
from .queries import _ANY, _BLOCK, _END, _SOURCE, _START, _STORED, _T, _TXN, _scratch, decoded_events, query, recorded
from .script import render, script_frame, script_lines, write_lines
from .status import as_dict, as_text
from .store import ChangeStore

_recorded: dict[tuple[str, str], ChangeStore] = {}


def shared_store(spark: SparkSession, sf_dir: str) -> ChangeStore:
    """The recorded store, built once a session for queries that only read it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _recorded or not _recorded[key].files.names("manifest"):
        _recorded[key] = recorded(spark, sf_dir)
    return _recorded[key]


def _rows(spark: SparkSession, rows: Iterable[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(list(rows), names)


def _text(x: object) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def expected(rows: Iterable[tuple], *names: str) -> str:
    values = ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {values}) v({', '.join(names)})"


def _outcome(act: Callable[[], object]) -> str:
    """What an action says, or how it is refused."""
    try:
        said = act()
    except BadRequest:
        return "bad request"
    except Refused as e:
        return f"refused: {e.rule}" if e.rule else "refused"
    except ValueError:
        return "bad value"
    return "done" if said is None else str(said)


# Scans


# A stored row bears the moment at which its transaction was committed.
_DONE = """, m AS (SELECT *, max(ev_at) OVER (PARTITION BY txn_id) AS done_at FROM c), s AS (SELECT *, row_number() OVER (ORDER BY txn_id % 10 > 5, txn_id, change_id) AS stored_id FROM m)"""
_IN_WINDOW = "ev_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:30:00'"


@query(_DONE + f" SELECT stored_id AS change_id, CAST(op AS INT) AS op, log_file, log_pos FROM s WHERE table_name = 'accounts' AND {_IN_WINDOW.replace('ev_at', 'done_at')}")
def gated_events(spark, sf_dir):
    snapshot = shared_store(spark, sf_dir).snapshot()
    found = snapshot.events(Filter((" Accounts ", ""), _START, _END), snapshot.coverage.end)
    return found.select("change_id", F.col("op").cast("int").alias("op"), "log_file", "log_pos")


@query(_STORED + """ SELECT 'newest' AS direction, row_number() OVER (ORDER BY stored_id DESC) AS place, stored_id AS change_id, log_pos FROM s QUALIFY place <= 100
UNION ALL SELECT 'oldest', row_number() OVER (ORDER BY stored_id) AS place, stored_id, log_pos FROM s QUALIFY place <= 100""")
def events_in_order(spark, sf_dir):
    """The first hundred rows that either ordered scan hands out, with their places."""
    snapshot = shared_store(spark, sf_dir).snapshot()
    now = snapshot.coverage.end
    newest = itertools.islice(snapshot.events_newest_first(now=now), 100)
    oldest = snapshot.events(now=now).limit(100).collect()
    rows = [(d, i, r["change_id"], r["log_pos"]) for d, found in (("newest", newest), ("oldest", oldest)) for i, r in enumerate(found, 1)]
    return _rows(spark, rows, "direction string, place long, change_id long, log_pos long")


@query(_DONE + """, r AS (SELECT stored_id AS id, row_number() OVER (ORDER BY stored_id DESC) AS n FROM s WHERE table_name = 'wallets' AND done_at <= TIMESTAMP '2024-01-12 12:30:00')
SELECT CAST((n - 1) // 40 AS BIGINT) AS page, id, CASE WHEN count(*) OVER p = 40 THEN min(id) OVER p ELSE 0 END AS next FROM r WHERE n <= 120 WINDOW p AS (PARTITION BY (n - 1) // 40)""")
def walk_pages(spark, sf_dir):
    """Three pages of forty, each begun by the cursor that the one before gave."""
    snapshot = shared_store(spark, sf_dir).snapshot()
    rows, cursor = [], 0
    for n in range(3):
        got = page(snapshot, Filter(("wallets",), None, _END), cursor, 40, snapshot.coverage.end)
        cursor = got.get("next", 0)
        rows += [(n, c["id"], cursor) for c in got["changes"]]
    return _rows(spark, rows, "page long, id long, next long")


@query("SELECT change_id FROM c WHERE table_name = 'wallets' OR table_name = 'accounts' AND change_id % 997 = 0")
def filter_names_trimmed(spark, sf_dir):
    ddl = F.when(F.col("change_id") % 997 == 0, F.lit(SCHEMA_CHANGE)).otherwise(F.col("op")).cast("tinyint")
    return changes(spark, sf_dir).withColumn("op", ddl).where(matches(Filter(("  shop.WALLETS ", " ", "")))).select("change_id")


# Store upkeep


_EDGE = ", p AS (SELECT txn_id, max(ev_at) OVER (PARTITION BY txn_id) AS last_at, (SELECT max(ev_at) FROM c) - INTERVAL 7 DAY AS edge FROM c)"


@query(f"""{_EDGE} SELECT 'before' AS stage, count(DISTINCT txn_id) FILTER (last_at < edge) AS removed, count(*) AS stored, count(*) AS on_disk FROM p
UNION ALL SELECT 'after', count(DISTINCT txn_id) FILTER (last_at < edge), count(*) FILTER (last_at >= edge), count(*) FILTER (last_at >= edge) FROM p""")
def prune_retention(spark, sf_dir):
    """Transactions removed, rows the store answers with, and rows left on disk."""
    store = recorded(spark, sf_dir)
    on_disk = lambda: spark.read.parquet(f"{store.root}/data/*/changes").count()
    before = (store.snapshot().changes().count(), on_disk())
    store.set_retention(RETENTION)
    removed = store.prune(store.snapshot().coverage.end)
    store.vacuum(timedelta(0))
    rows = [("before", removed, *before), ("after", removed, store.snapshot().changes().count(), on_disk())]
    return _rows(spark, rows, "stage string, removed long, stored long, on_disk long")


@query(_STORED + " SELECT stored_id AS change_id, 'fixture:' || txn_id AS source_txn_id, log_pos FROM s")
def store_compacted(spark, sf_dir):
    """The store after its folders were merged and the old ones deleted."""
    store = recorded(spark, sf_dir)
    store.compact(small=None, most=1)
    store.vacuum(timedelta(0))
    assert len(store.snapshot().manifest["folders"]) == 1
    return store.snapshot().changes().select("change_id", "source_txn_id", "log_pos")


@query("SELECT DISTINCT CAST(FLOOR(event_id / 4) AS BIGINT) AS txn_id FROM events WHERE CAST(FLOOR(event_id / 4) AS BIGINT) NOT IN (SELECT txn_id FROM c WHERE op <> 2)")
def integrity_rowless(spark, sf_dir):
    txns = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.col("event_id") / 4).cast("long").alias("txn_id")).distinct()
    return rowless(txns, changes(spark, sf_dir).where("op <> 2"))


@query("SELECT table_name, TIMESTAMP '2024-01-30 23:50:00' > coalesce(max(ev_at), TIMESTAMP '2024-01-30 23:50:00') AS ahead FROM c GROUP BY table_name")
def checkpoint_ahead(spark, sf_dir):
    at = F.lit(datetime(2024, 1, 30, 23, 50, tzinfo=UTC))
    return changes(spark, sf_dir).groupBy("table_name").agg(ahead(F.max("committed_at"), at).alias("ahead"))


@query("SELECT strftime(min(ev_at), '%Y-%m-%d %H:%M:%S') AS covered_from, strftime(greatest(TIMESTAMP '2024-01-02 00:00:00', max(ev_at)), '%Y-%m-%d %H:%M:%S') AS covered_to FROM c")
def coverage_bounds(spark, sf_dir):
    mark = highest(F.lit(datetime(2024, 1, 2, tzinfo=UTC)), F.max("committed_at"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return changes(spark, sf_dir).agg(text(earliest()).alias("covered_from"), text(mark).alias("covered_to"))


@query("SELECT 'stored' AS what, count(*) AS n FROM c WHERE txn_id % 2 = 0 UNION ALL SELECT 'refused', 1")
def append_refused(spark, sf_dir):
    """One value without a literal keeps its whole batch out; the batch before stays."""
    store = ChangeStore(spark, _scratch(spark))
    rows = changes(spark, sf_dir).withColumn("ord", F.col("change_id"))
    store.append(rows.where("txn_id % 2 = 0"), order=["ord"])
    names = rows.schema["after"].dataType.elementType.fieldNames()
    bad = lambda c: F.when(c["raw"].isNotNull(), F.struct(*[(F.lit("1 OR 1") if f == "raw" else c[f]).alias(f) for f in names])).otherwise(c)
    others = rows.where("txn_id % 2 = 1")
    last = others.where("op = 1").agg(F.max("change_id")).first()[0]
    broken = others.withColumn("after", F.when(F.col("change_id") == last, F.transform("after", bad)).otherwise(F.col("after")))
    said = _outcome(lambda: store.append(broken, order=["ord"]))
    stored = store.snapshot().changes().agg(F.count(F.lit(1)).alias("n")).select(F.lit("stored").alias("what"), "n")
    return stored.unionByName(_rows(spark, [("refused", int(said == "refused"))], "what string, n long"))


_T0 = datetime(2024, 3, 1, tzinfo=UTC)
_MINE = Binding("mysql", "mysql:u", "", "v1")


@query(expected([
    ("first mark", "2024-03-01T00:00:00Z"), ("second mark", "2024-03-01T00:00:00Z"), ("mark forward", "2024-03-03T00:00:00Z"), ("mark back", "2024-03-03T00:00:00Z"),
    ("staleness", "120"), ("retention", "86400"), ("bind", "done"), ("bind again", "done"), ("bind other flavor", "refused"), ("bind other server", "refused"),
    ("bind other dialect", "refused"), ("bind other decoder", "refused"), ("gaps", "2024-03-01T00:00:00Z,2024-03-02T00:00:00Z"), ("misses", "m1,m2"), ("name taken", "False"),
    ("newer layout", "refused"), ("no store", "refused"),
], "step", "outcome"), flat=False)
def store_settings(spark, sf_dir):
    """Marks, limits, binding, gaps, misses and layouts of a fresh store, step by step."""
    store = ChangeStore(spark, _scratch(spark))
    day = timedelta(days=1)
    out = []
    for name, moment in (("first mark", _T0), ("second mark", _T0 + day)):
        store.open_coverage(moment)
        out.append((name, rfc3339(store.snapshot().coverage.start)))
    for name, moment in (("mark forward", _T0 + 2 * day), ("mark back", _T0 + day)):
        store.advance_coverage(moment)
        out.append((name, rfc3339(store.snapshot().coverage.end)))
    store.set_max_staleness(timedelta(minutes=2))
    store.set_retention(day)
    held = store.snapshot().coverage
    out += [("staleness", str(int(held.max_staleness.total_seconds()))), ("retention", str(int(held.retention.total_seconds())))]
    others = [("flavor", Binding("mariadb", "mysql:u", "", "v1")), ("server", Binding("mysql", "mysql:w", "", "v1")), ("dialect", Binding("mysql", "mysql:u", "mysql", "v1")), ("decoder", Binding("mysql", "mysql:u", "", "v2"))]
    for name, b in (("bind", _MINE), ("bind again", _MINE), *((f"bind other {n}", b) for n, b in others)):
        out.append((name, _outcome(lambda b=b: store.bind(b))))
    store.record_gap(_T0 + day, _T0 + day, "later")
    store.record_gap(_T0, _T0, "sooner")
    store.record_misses([Miss(_T0 + day, "m2"), Miss(_T0, "m1")])
    s = store.snapshot()
    out += [("gaps", ",".join(rfc3339(g.start) for g in s.gaps)), ("misses", ",".join(m.reason for m in s.misses))]
    out.append(("name taken", str(store.files.create(f"manifest/{s.version:010d}.json", "{}"))))
    store.files.create(f"manifest/{s.version + 1:010d}.json", json.dumps(s.manifest | {"schema_version": 99}))
    out.append(("newer layout", _outcome(store.snapshot)))
    out.append(("no store", _outcome(lambda: ChangeStore(spark, _scratch(spark), create=False))))
    return _rows(spark, out, "step string, outcome string")


# Hours after _T0: where coverage begins and ends, the window, now; a gap lies at 20 to 22,
# a missed change at 30.
_CASES = list(itertools.product((None, 0, 10), (None, 48), (None, -5, 12, 21, 23, 31), (None, 15, 20, 25, 48, 49), (47, 49)))


def _hours(h: int | None) -> datetime | None:
    return None if h is None else _T0 + timedelta(hours=h)


@query(f"""WITH k(a, b, f, t, n) AS (VALUES {', '.join('(' + ', '.join('NULL::INT' if x is None else str(x) for x in c) + ')' for c in _CASES)}),
w AS (SELECT *, coalesce(f, a) AS lo, coalesce(t, b) AS hi FROM k WHERE f IS NULL OR t IS NULL OR f <= t)
SELECT coalesce(a, -99) AS a, coalesce(b, -99) AS b, coalesce(f, -99) AS f, coalesce(t, -99) AS t, n, CASE WHEN b IS NULL THEN 'refused: empty' WHEN (n - b) * 60 > 5 THEN 'refused: stale'
  WHEN f < a THEN 'refused: before coverage' WHEN (t - b) * 60 > 5 THEN 'refused: past coverage'
  WHEN (lo IS NULL OR lo <= 22) AND hi >= 20 THEN 'refused: gap' WHEN (lo IS NULL OR lo <= 30) AND hi >= 30 THEN 'refused: miss' ELSE 'done' END AS outcome FROM w""", flat=False)  # fmt: skip
def gate_outcomes(spark, sf_dir):
    """The coverage gate over a grid of coverages, windows and clocks."""
    gaps, misses = [Gap(_hours(20), _hours(22), "lost")], [Miss(_hours(30), "odd")]
    out = []
    for a, b, f, t, n in _CASES:
        if f is not None and t is not None and f > t:
            continue
        said = _outcome(lambda a=a, b=b, f=f, t=t, n=n: check(Coverage(_hours(a), _hours(b)), Filter((), _hours(f), _hours(t)), _hours(n), gaps, misses))
        out.append((*(-99 if x is None else x for x in (a, b, f, t)), n, said))
    return _rows(spark, out, "a int, b int, f int, t int, n int, outcome string")


@query(_DONE + """ SELECT 'healthy' AS key, 'true' AS value UNION ALL SELECT 'covered from', strftime(min(done_at), '%Y-%m-%dT%H:%M:%SZ') FROM m UNION ALL SELECT 'covered to', strftime(max(ev_at), '%Y-%m-%dT%H:%M:%SZ') FROM c
UNION ALL SELECT * FROM (VALUES ('stale', '10'), ('problems', '0'), ('gaps', '1'), ('misses', '1'), ('source', 'mysql:u'), ('text', 'OK'), ('stale verdict', 'false'), ('ahead verdict', 'false'))""")
def store_status(spark, sf_dir):
    """Health of the recorded store as a dictionary and as text; history never decides."""
    store = ChangeStore(spark, _scratch(spark))
    store.append(changes(spark, sf_dir).withColumn("ord", F.col("change_id")), order=["ord"], checkpoint={"log_file": "x", "log_pos": 4, "gtid": None, "updated_at": 0})
    store.bind(_MINE)
    store.record_gap(_T0, _T0, "lost")
    store.record_misses([Miss(_T0, "odd")])
    s = store.snapshot()
    report = s.status(s.coverage.end + timedelta(seconds=10))
    d = as_dict("x", report)
    late = s.status(s.coverage.end + timedelta(hours=1))
    store.append(s.changes().limit(0).withColumn("ord", F.lit(1)), order=["ord"], checkpoint={"log_file": "x", "log_pos": 5, "gtid": None, "updated_at": int(s.coverage.end.timestamp()) + 1})
    early = store.snapshot().status(s.coverage.end)
    flag = lambda x: str(x).lower()
    rows = [
        ("healthy", flag(d["healthy"])), ("covered from", d["coverage"]["from"]), ("covered to", d["coverage"]["to"]), ("stale", str(d["stale_seconds"])), ("problems", str(len(d["integrity_problems"]))),
        ("gaps", str(len(d["gaps"]))), ("misses", str(len(d["misses"]))), ("source", d["source"]["server_identity"]), ("text", as_text("x", report).splitlines()[1].split()[-1]),
        ("stale verdict", flag(late.healthy())), ("ahead verdict", flag(early.healthy())),
    ]
    return _rows(spark, rows, "key string, value string")


# Records


_VARINT = "CASE WHEN 2 * id < 128 THEN 1 WHEN 2 * id < 16384 THEN 2 WHEN 2 * id < 2097152 THEN 3 ELSE 4 END"
_LENGTH = f"2 + 1 + {_VARINT} + 2 + strlen({{0}}_status) + 2 + strlen(CAST({{0}}_total AS VARCHAR))"


@query(f"""SELECT change_id, CASE WHEN op IN (2, 3) THEN {_LENGTH.format('b')} END AS before_bytes, CASE WHEN op IN (1, 2) THEN {_LENGTH.format('a')} END AS after_bytes, true AS same FROM c""")
def codec_round_trip(spark, sf_dir):
    """Every image as a binary record and back."""
    encode, decode = encode_rows_udf(), decode_rows_udf()
    coded = changes(spark, sf_dir).select("change_id", "before", "after", encode("before").alias("b"), encode("after").alias("a"))
    same = decode("b").eqNullSafe(F.col("before")) & decode("a").eqNullSafe(F.col("after"))
    return coded.select("change_id", F.octet_length("b").cast("long").alias("before_bytes"), F.octet_length("a").cast("long").alias("after_bytes"), same.alias("same"))


# Scripts


_SOME = "table_name = 'wallets' AND change_id < 600"
_PINNED = "'-- REVIEW BEFORE RUNNING — nothing here has been executed.', '', 'SET time_zone = ''+00:00'';', 'SET NAMES utf8mb4;'"


@query(f"""SELECT line FROM (SELECT unnest(string_split({_BLOCK}, chr(10))) AS line FROM c WHERE {_SOME})
UNION ALL SELECT unnest(['-- rowtide revert script', '-- source: fixture', {_PINNED}, ''])
UNION ALL SELECT unnest(['-- ' || count(*) || ' statements, newest change first', '-- end of script: ' || count(*) || ' statements']) FROM c WHERE {_SOME}""")
def script_header_count(spark, sf_dir):
    """A small script in one string, whose header names its number of statements."""
    text = render(changes(spark, sf_dir).where(_SOME), "fixture")
    return _rows(spark, [(x,) for x in text.splitlines()], "line string")


@query(f"""SELECT line FROM (SELECT unnest(string_split({_BLOCK}, chr(10))) AS line FROM c WHERE {_IN_WINDOW} AND table_name = 'accounts')
UNION ALL SELECT unnest(['-- rowtide revert script', '-- source: fixture', '-- window: 2024-01-05 00:00:00 UTC to 2024-01-12 12:30:00 UTC', '-- newest change first', {_PINNED}, ''])
UNION ALL SELECT '-- end of script: ' || count(*) || ' statements' FROM c WHERE {_IN_WINDOW} AND table_name = 'accounts'""")
def script_in_window(spark, sf_dir):
    f = Filter(("accounts",), _START, _END)
    return script_frame(changes(spark, sf_dir).where(matches(f)), "fixture", f).select("line")


@query(f"""SELECT place, statement FROM (SELECT row_number() OVER (ORDER BY change_id DESC) AS place, {_ANY} AS statement FROM c WHERE {_SOME}) UNION ALL SELECT 0, 'refused'""")
def script_file(spark, sf_dir):
    """A script file, whole and in order; an existing one is not replaced unasked."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "undo.sql")
        write_lines(script_lines(changes(spark, sf_dir).where(_SOME), "fixture"), path)
        again = _outcome(lambda: write_lines(["x"], path))
        with open(path, encoding="utf-8") as f:
            said = [x.rstrip("\n") for x in f if not x.startswith(("--", "SET ", "\n"))]
    return _rows(spark, [(0, again), *enumerate(said, 1)], "place long, statement string")


@query(f"""SELECT change_id, CASE WHEN op = 1 THEN 'after image for ' || {_T} || ' has 2 values for 3 columns' WHEN op = 3 THEN 'before image for ' || {_T} || ' has 0 values for 3 columns'
  ELSE 'before image for ' || {_T} || ' has 4 values for 3 columns' END AS refusal, true AS silent FROM c WHERE change_id % 6 = 0""")
def short_images(spark, sf_dir):
    """Images that are short, missing or too long refuse their change and name the table."""
    some = changes(spark, sf_dir).where("change_id % 6 = 0")
    some = some.withColumn("after", F.when(F.col("op") == 1, F.slice("after", 1, 2)).otherwise(F.col("after")))
    some = some.withColumn("before", F.when(F.col("op") == 2, F.concat("before", F.slice("before", 1, 1))))
    return with_statements(some).select("change_id", "refusal", F.col("statement").isNull().alias("silent"))


# Assembly and collection


@query(f""", {_TXN} SELECT {_SOURCE} AS source_txn_id, count(*) AS n, CAST(sum(op) AS BIGINT) AS ops, min(CASE WHEN txn_id % 2 = 0 THEN pos ELSE log_pos END) AS first_pos FROM c JOIN t USING (txn_id, log_file) WHERE txn_id % 17 <> 0 GROUP BY 1""")
def payload_transactions(spark, sf_dir):
    """Every second transaction arrives as one compressed payload, whose place its rows take."""
    events = decoded_events(spark, sf_dir).withColumn("txn", F.floor(F.floor(F.col("event_ord") / 10) / 4))
    inner = [c for c in events.columns if c not in ("stream", "file_ord", "log_file", "log_pos", "event_ord", "txn")]
    packed = events.where("txn % 2 = 0").groupBy("stream", "file_ord", "log_file", "txn").agg(
        F.max("log_pos").alias("log_pos"), F.min("event_ord").alias("event_ord"), F.array_sort(F.collect_list(F.struct(F.col("event_ord").alias("o"), F.struct(*inner).alias("e")))).alias("all")
    )
    packed = packed.withColumn("payload", F.transform("all", lambda x: x["e"])).drop("all")
    kinds = {x.name: x.dataType for x in events.schema}
    for c in inner:
        packed = packed.withColumn(c, F.lit("TRANSACTION_PAYLOAD") if c == "event_type" else F.lit(None).cast(kinds[c]))
    plain = events.where("txn % 2 = 1").withColumn("payload", F.lit(None).cast(packed.schema["payload"].dataType))
    found = assemble(plain.drop("txn").unionByName(packed.drop("txn"))).changes
    return found.groupBy("source_txn_id").agg(F.count(F.lit(1)).alias("n"), F.sum("op").alias("ops"), F.min("log_pos").alias("first_pos"))


@query(f""", {_TXN} SELECT log_file || ':' || (pos + 11) AS source_txn_id, 'ALTER TABLE t ADD COLUMN x INT' AS query, '' AS table_name, strftime(ev_at, '%Y-%m-%d %H:%M:%S') AS committed_at
FROM t JOIN (SELECT change_id AS last_id, ev_at FROM c) USING (last_id) WHERE txn_id % 29 = 0""")
def ddl_transactions(spark, sf_dir):
    """Schema-changing statements between transactions are changes of their own."""
    events = decoded_events(spark, sf_dir)
    ends = events.where("event_ord % 10 = 9 and floor(floor(event_ord / 10) / 4) % 29 = 0")
    ddl = ends.withColumns({"event_ord": F.col("event_ord") + 1, "event_type": F.lit("QUERY"), "statement": F.lit(" ALTER TABLE t ADD COLUMN x INT "), "log_pos": F.col("log_pos") + 11})
    found = assemble(events.unionByName(ddl)).changes.where(F.col("op") == SCHEMA_CHANGE)
    return found.select("source_txn_id", "query", "table_name", F.date_format("committed_at", "yyyy-MM-dd HH:mm:ss").alias("committed_at"))


@query("SELECT strftime(ev_at, '%Y-%m-%d %H:%M:%S') AS moment, count(*) AS n FROM c WHERE change_id % 7 = 0 GROUP BY 1")
def missed_events(spark, sf_dir):
    """Row events that cannot be read are recorded as missed, by moment, and kept as rows."""
    bad = op_of(F.col("event_type")).isNotNull() & (F.floor(F.col("event_ord") / 10) % 7 == 0)
    events = decoded_events(spark, sf_dir).withColumn("skipped", F.when(bad, F.array(F.array(F.lit(1)))).otherwise(F.col("skipped")))
    store = ChangeStore(spark, _scratch(spark))
    Collector(store).process(events.withColumn("sub_ord", F.lit(0)), 0)
    found = store.snapshot().missed()
    return found.groupBy(F.date_format("moment", "yyyy-MM-dd HH:mm:ss").alias("moment")).agg(F.count(F.lit(1)).alias("n"))


def _collected(spark: SparkSession, sf_dir: str) -> ChangeStore:
    """Wallets only, in two batches that part a transaction, the second delivered twice."""
    events = decoded_events(spark, sf_dir).withColumn("sub_ord", F.lit(0))
    middle = events.agg(F.floor(F.avg(F.floor(F.col("event_ord") / 10))).alias("m")).first()["m"] * 10 + 5
    store = ChangeStore(spark, _scratch(spark))
    collector = Collector(store, f=Filter(("wallets",)))
    for batch, part in ((0, events.where(F.col("event_ord") <= middle)), (1, events.where(F.col("event_ord") > middle)), (1, events)):
        collector.process(part, batch)
    return store


@query(f""", {_TXN} SELECT {_SOURCE} AS source_txn_id, log_pos FROM c JOIN t USING (txn_id, log_file) WHERE txn_id % 17 <> 0 AND table_name = 'wallets'""")
def collect_filtered(spark, sf_dir):
    return _collected(spark, sf_dir).snapshot().changes().select("source_txn_id", "log_pos")


@query(f""", {_TXN}, z AS (SELECT log_file, pos FROM t ORDER BY last_id DESC LIMIT 1)
SELECT strftime(max(ev_at), '%Y-%m-%d %H:%M:%S') AS reached, (SELECT log_file || ':' || pos FROM z) AS resume_at, CAST(1 AS BIGINT) AS last_batch, 'false' AS waiting, CAST(1 AS BIGINT) AS gaps FROM c""")
def collector_state(spark, sf_dir):
    """How far a collector got, where it resumes, and the gap that a lost position leaves."""
    store = _collected(spark, sf_dir)
    Collector(store, clock=lambda: _T0).lost_position(_T0 - timedelta(hours=1))
    s = store.snapshot()
    place = s.manifest["checkpoint"]
    row = (s.coverage.end.strftime("%Y-%m-%d %H:%M:%S"), f"{place['log_file']}:{place['log_pos']}", s.manifest["batches"]["collector"], str(place["tail"] is not None).lower(), len(s.gaps))
    return _rows(spark, [row], "reached string, resume_at string, last_batch long, waiting string, gaps long")


@query("SELECT change_id, CAST(op AS INT) AS op, CASE WHEN log_file = (SELECT max(log_file) FROM c) THEN 0 ELSE 1 END AS file_ord, log_pos FROM c")
def multi_file_scan(spark, sf_dir):
    """Files are read in the order they are named, here the newest first."""
    events = decoded_events(spark, sf_dir).drop("stream", "file_ord")
    newest = events.agg(F.max("log_file")).first()[0]
    base = _scratch(spark)
    for name, part in (("new", F.col("log_file") == newest), ("old", F.col("log_file") != newest)):
        events.where(part).write.parquet(f"{base}/{name}")
    found = read_changes(spark, [f"{base}/new", f"{base}/old"])
    return found.select(F.floor(F.col("event_ord") / 10).cast("long").alias("change_id"), F.col("op").cast("int").alias("op"), "file_ord", "log_pos")


@query(expected([
    ("bad file among good ones", "refused"), ("no file", "refused"), ("prepared transaction", "refused"), ("second collector", "refused"), ("open address", "refused"), ("empty token", "bad value"),
    ("inverted window", "bad request"), ("loopback", "True"), ("not loopback", "False"),
], "name", "outcome"), flat=False)
def refusals(spark, sf_dir):
    """Questions that are refused whole, by what is wrong with them."""
    events = decoded_events(spark, sf_dir).where("event_ord < 400")
    base = _scratch(spark)
    plain = events.drop("stream", "file_ord")
    plain.write.parquet(f"{base}/good")
    plain.withColumn("skipped", F.when(op_of(F.col("event_type")).isNotNull(), F.array(F.array(F.lit(1))))).write.parquet(f"{base}/bad")
    xa = events.unionByName(events.limit(1).withColumns({"event_type": F.lit("QUERY"), "statement": F.lit("xa end 'x'"), "event_ord": F.lit(9999).cast("long")}))
    store = shared_store(spark, sf_dir)

    def claim_twice() -> None:
        with tempfile.TemporaryDirectory() as folder, Claim(f"{folder}/lock"):
            Claim(f"{folder}/lock")

    rows = [
        ("bad file among good ones", lambda: read_changes(spark, [f"{base}/good", f"{base}/bad"]).count()), ("no file", lambda: read_changes(spark, [])), ("prepared transaction", lambda: assemble(xa)),
        ("second collector", claim_twice), ("open address", lambda: serve(Api(store, "x"), "0.0.0.0", 0)), ("empty token", lambda: Api(store, "x", token="")),
        ("inverted window", lambda: Filter((), _END, _START)), ("loopback", lambda: all(map(is_loopback, ("127.0.0.1", "::1", "localhost")))), ("not loopback", lambda: any(map(is_loopback, ("", "0.0.0.0", "db.example")))),
    ]
    return _rows(spark, [(n, _outcome(act)) for n, act in rows], "name string, outcome string")


# The facade


_LOOK = [
    ("GET", "/api/status", "", 200, "application/json"), ("GET", "/api/changes?limit=3", "", 200, "application/json"), ("GET", "/api/changes?limit=lots", "", 400, "application/json"),
    ("GET", "/api/changes?from=2024-02-01&to=2024-01-01", "", 400, "application/json"), ("GET", "/api/changes?from=2001-01-01", "", 409, "application/json"), ("GET", "/api/changes/1", "", 200, "application/json"),
    ("GET", "/api/changes/99999999", "", 404, "application/json"), ("GET", "/api/changes/x", "", 400, "application/json"), ("GET", "/api/changes/", "", 400, "application/json"),
    ("GET", "/api/revert.sql?from=2001-01-01", "", 409, "application/json"), ("GET", "/api/revert.sql?tables=wallets&to=2024-01-02", "", 200, "text/plain; charset=utf-8"), ("HEAD", "/api/status", "", 200, "application/json"),
    ("POST", "/api/status", "", 405, "application/json"), ("GET", "/nowhere", "", 404, "application/json"), ("GET", "/api/changes/1/2", "", 404, "application/json"),
    ("GET", "/api/status", "secret", 200, "application/json"), ("GET", "/api/status", "wrong", 401, "application/json"),
]


@query(expected([(m, t, w, s, k) for m, t, w, s, k in _LOOK], "method", "target", "word", "status", "kind"), flat=False)
def api_responses(spark, sf_dir):
    """Status and type of what the facade says, with and without a token."""
    store = shared_store(spark, sf_dir)
    now = store.snapshot().coverage.end
    rows = []
    for method, target, word, *_ in _LOOK:
        api = Api(store, "x", token="secret" if word else None, clock=lambda: now)
        status, headers, _ = api.respond(method, target, f"Bearer {word}" if word else "")
        rows.append((method, target, word, status, headers["Content-Type"]))
    return _rows(spark, rows, "method string, target string, word string, status int, kind string")


@query(_DONE + """ SELECT 'change' AS what, stored_id AS id, table_name AS said FROM s WHERE table_name = 'wallets' QUALIFY row_number() OVER (ORDER BY stored_id DESC) <= 7
UNION ALL SELECT 'one', 5, CASE (SELECT op FROM s WHERE stored_id = 5) WHEN 1 THEN 'INSERT' WHEN 2 THEN 'UPDATE' ELSE 'DELETE' END
UNION ALL SELECT 'statements', count(*), 'attachment; filename="revert.sql"' FROM s WHERE table_name = 'wallets' AND done_at <= TIMESTAMP '2024-01-03 00:00:00'""")
def api_bodies(spark, sf_dir):
    """What stands in the bodies: a page, one change, the statements of a script."""
    store = shared_store(spark, sf_dir)
    now = store.snapshot().coverage.end
    api = Api(store, "x", clock=lambda: now)
    listed = json.loads("".join(api.respond("GET", "/api/changes?tables=wallets&limit=7")[2]))["changes"]
    one = json.loads("".join(api.respond("GET", "/api/changes/5")[2]))
    _, headers, body = api.respond("GET", "/api/revert.sql?tables=wallets&to=2024-01-03T00:00:00Z")
    n = sum(line.startswith(("DELETE", "UPDATE", "INSERT")) for line in body)
    rows = [("change", c["id"], c["table"]) for c in listed] + [("one", one["id"], one["op"]), ("statements", n, headers["Content-Disposition"])]
    return _rows(spark, rows, "what string, id long, said string")


@query(expected([
    ("no command", 2), ("help", 0), ("version", 0), ("nonsense", 2), ("status", 0), ("status as json", 0), ("status when stale", 1), ("status of no store", 1), ("generate without source", 2),
    ("generate", 0), ("generate again", 2), ("generate by force", 0), ("generate before coverage", 1), ("serve openly", 2), ("watch once", 0),
], "name", "code"), flat=False)
def cli_exit_codes(spark, sf_dir):
    store = shared_store(spark, sf_dir)
    now = store.snapshot().coverage.end
    late = now + timedelta(hours=1)
    decoded_events(spark, sf_dir).where("event_ord < 400").withColumn("sub_ord", F.lit(0)).write.json(f"{store.root}/log-{os.urandom(4).hex()}")
    with tempfile.TemporaryDirectory() as folder:
        out = os.path.join(folder, "undo.sql")
        write = ["generate", "--store", store.root, "--tables", "wallets", "--to", "2024-01-02T00:00:00Z", "--out", out]
        log = os.path.join(folder, "log")
        os.mkdir(log)
        runs = [
            ("no command", [], now), ("help", ["help"], now), ("version", ["version"], now), ("nonsense", ["nonsense"], now), ("status", ["status", "--store", store.root], now),
            ("status as json", ["status", "--store", store.root, "--json"], now), ("status when stale", ["status", "--store", store.root], late), ("status of no store", ["status", "--store", f"{store.root}-none"], now),
            ("generate without source", ["generate"], now), ("generate", write, now), ("generate again", write, now), ("generate by force", [*write, "--force"], now),
            ("generate before coverage", ["generate", "--store", store.root, "--from", "2001-01-01"], now), ("serve openly", ["serve", "--store", store.root, "--host", "0.0.0.0"], now),
            ("watch once", ["watch", "--store", os.path.join(folder, "s"), "--log", log, "--once"], now),
        ]
        rows = []
        for name, argv, moment in runs:
            with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
                rows.append((name, cli.main(argv, spark, moment)))
    return _rows(spark, rows, "name string, code int")


# Words that an operator types


_NOW = datetime(2024, 5, 6, 12, 0, tzinfo=UTC)
_EAST = timezone(timedelta(hours=2))


@query(expected([
    ("2024-05-01", "2024-04-30T22:00:00Z"), ("2024-05-01 10:30", "2024-05-01T08:30:00Z"), ("2024-05-01T10:30:15", "2024-05-01T08:30:15Z"), ("2024-05-01T10:30:15Z", "2024-05-01T10:30:15Z"),
    ("2024-05-01T10:30:15-03:30", "2024-05-01T14:00:15Z"), ("09:15", "2024-05-06T07:15:00Z"), ("14:00", "2024-05-06T12:00:00Z"), ("14:01", "2024-05-05T12:01:00Z"), ("23:59:59", "2024-05-05T21:59:59Z"),
    ("yesterday", "bad request"), ("2024-13-01", "bad request"), ("25:00", "bad request"), ("", "bad request"),
], "said", "moment"), flat=False)
def moments_parsed(spark, sf_dir):
    """Moments as typed two hours east of UTC at 14:00 there."""
    texts = ["2024-05-01", "2024-05-01 10:30", "2024-05-01T10:30:15", "2024-05-01T10:30:15Z", "2024-05-01T10:30:15-03:30", "09:15", "14:00", "14:01", "23:59:59", "yesterday", "2024-13-01", "25:00", ""]
    return _rows(spark, [(t, _outcome(lambda t=t: rfc3339(parse_time(t, _NOW, _EAST)))) for t in texts], "said string, moment string")


@query(expected([
    ("list", " a, ,b,", "a|b"), ("list", "", ""), ("number", "", "0"), ("number", "-7", "-7"), ("number", "9223372036854775808", "bad request"), ("number", "1e3", "bad request"),
    ("window", "2024-05-01/", "2024-05-01T00:00:00Z/"), ("window", "/2024-05-02", "/2024-05-02T00:00:00Z"), ("window", "2024-05-02/2024-05-01", "bad request"), ("window", "x/", "bad request"),
], "kind", "said", "meant"), flat=False)
def parameters_read(spark, sf_dir):
    def window(text: str) -> str:
        start, _, end = text.partition("/")
        f = filter_from({"from": start, "to": end}, _NOW, UTC)
        return "/".join("" if x is None else rfc3339(x) for x in (f.start, f.end))

    read = {"list": lambda t: "|".join(split_list(t)), "number": lambda t: whole_number(t, "n"), "window": window}
    said = [("list", " a, ,b,"), ("list", ""), ("number", ""), ("number", "-7"), ("number", "9223372036854775808"), ("number", "1e3"), ("window", "2024-05-01/"), ("window", "/2024-05-02"), ("window", "2024-05-02/2024-05-01"), ("window", "x/")]
    return _rows(spark, [(k, t, _outcome(lambda k=k, t=t: read[k](t))) for k, t in said], "kind string, said string, meant string")


@query(expected([
    ("u:p@tcp(db:3307)/shop", "u|db:3307", "u:***@tcp(db:3307)/shop"), ("u:p@db", "u|db:3306", "u:***@db"), ("u:p@x@db:1/", "u|db:1", "u:***@db:1/"), ("u@db", "u|db:3306", "u@db"),
    ("", "refused", ""), ("db:3306", "refused", "db:3306"), (":p@db", "refused", ":***@db"), ("u:p@tcp(db", "refused", "u:***@tcp(db"), ("u:p@/shop", "refused", "u:***@/shop"),
], "said", "read", "shown"), flat=False)
def connection_strings(spark, sf_dir):
    texts = ["u:p@tcp(db:3307)/shop", "u:p@db", "u:p@x@db:1/", "u@db", "", "db:3306", ":p@db", "u:p@tcp(db", "u:p@/shop"]

    def read(text: str) -> str:
        c = ConnectionString.parse(text)
        return f"{c.user}|{c.address}"

    return _rows(spark, [(t, _outcome(lambda t=t: read(t)), redact(t)) for t in texts], "said string, read string, shown string")


_GOOD = {"binlog_format": "ROW", "binlog_row_image": "FULL", "binlog_row_metadata": "full", "server_uuid": "u1", "server_id": "3", "gtid_mode": "ON"}


@query(expected([
    ("good", "done"), ("statement format", "refused"), ("minimal image", "refused"), ("no metadata", "refused"), ("partial json", "refused"), ("mysql", "mysql:u1 mysql False"), ("mysql without gtids", "mysql:u1  False"),
    ("mariadb", "mariadb:2:3 mariadb True"), ("nameless", "refused"), ("decoder", "v1;parse_time=true;exact_decimal=true;verify_checksum=true;tz=UTC"), ("decoder by choice", "v1;parse_time=false;exact_decimal=true;verify_checksum=false;tz=UTC"),
    ("generated", "shop.wallets.total"), ("bound", "mysql mysql:u1 mysql"),
], "name", "outcome"), flat=False)
def server_checks(spark, sf_dir):
    """What a source must report, what names it, and what a decoder must have done."""
    catalogue = _rows(spark, [("shop", "wallets", "total", "VIRTUAL generated"), ("shop", "wallets", "id", "auto_increment")], "TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string, EXTRA string")

    def named(version: str, variables: dict) -> str:
        flavor = flavor_of(version)
        name, dialect = identity(flavor, variables)
        return f"{name} {dialect} {statement_capture(flavor, variables)}"

    def bound() -> str:
        b = preflight("8.4.1", _GOOD).binding
        return f"{b.flavor} {b.server_identity} {b.gtid_dialect}"

    rows = [
        ("good", lambda: check_settings(_GOOD)), ("statement format", lambda: check_settings(_GOOD | {"binlog_format": "STATEMENT"})), ("minimal image", lambda: check_settings(_GOOD | {"binlog_row_image": "MINIMAL"})),
        ("no metadata", lambda: check_settings({k: v for k, v in _GOOD.items() if k != "binlog_row_metadata"})), ("partial json", lambda: check_settings(_GOOD | {"binlog_row_value_options": "partial_json"})),
        ("mysql", lambda: named("8.4.1", _GOOD)), ("mysql without gtids", lambda: named("8.4.1", _GOOD | {"gtid_mode": "OFF"})),
        ("mariadb", lambda: named("11.4-MariaDB", _GOOD | {"gtid_domain_id": "2", "binlog_annotate_row_events": "on"})), ("nameless", lambda: named("8.0", {})),
        ("decoder", lambda: DecodeOptions().fingerprint()), ("decoder by choice", lambda: DecodeOptions(parse_time=False, verify_checksum=False).fingerprint()),
        ("generated", lambda: ",".join(".".join(r) for r in generated_columns(catalogue).collect())), ("bound", bound),
    ]
    return _rows(spark, [(n, _outcome(act)) for n, act in rows], "name string, outcome string")
