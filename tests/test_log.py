from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from rowtide.functions.predicates import Filter, Refused
from rowtide.operators import running
from rowtide.operators.assemble import STREAM_SCHEMA, assemble
from rowtide.operators.normalise import EVENT_SCHEMA, file_changes, with_positions
from rowtide.operators.running import running_sum
from rowtide.sources.decoded_log import DecodeOptions, read_changes

T0 = datetime(2024, 1, 1, tzinfo=UTC)
ROW = {"tag": 1, "i": 1, "u": None, "f": None, "d": None, "b": None, "bin": None, "t": None, "raw": None}


def events(spark, *rows, stream=True):
    """Rows of (event_type, changes to the defaults); positions count up."""
    out = []
    for n, (kind, more) in enumerate(rows):
        image = [[ROW]] if "WRITE" in kind or "DELETE" in kind else [[ROW], [ROW | {"i": 2}]] if "UPDATE" in kind else None
        e = {
            "log_file": "log.1", "file_ord": 0, "event_ord": n, "event_type": kind, "log_pos": 100 + n, "event_size": 10, "event_at": datetime.fromtimestamp(T0.timestamp() + n, UTC), "server_id": 5,
            "schema_name": "shop" if image else None, "table_name": "orders" if image else None, "names": ["id"] if image else None, "pk": [0] if image else None, "skipped": None, "images": image, "statement": None, "gtid": None,
        }
        out.append(e | ({"stream": "s", "sub_ord": 0} if stream else {}) | more)
    schema = STREAM_SCHEMA if stream else EVENT_SCHEMA
    names = spark.createDataFrame([], schema).columns
    return spark.createDataFrame([tuple(e[n] for n in names) for e in out], schema)


Q = lambda s: ("QUERY", {"statement": s})


def test_a_transaction_is_its_committed_rows(spark):
    log = events(
        spark, ("GTID", {"gtid": "g1"}), Q("BEGIN"), ("ROWS_QUERY", {"statement": "insert"}), ("WRITE_ROWS_V2", {}), ("UPDATE_ROWS_V1", {}), ("XID", {}),
        Q("BEGIN"), ("DELETE_ROWS_V0", {}), Q("ROLLBACK"), ("WRITE_ROWS_V2", {}), Q("COMMIT"), Q("BEGIN"), ("WRITE_ROWS_V2", {}),
    )
    found = assemble(log)
    rows = [(r["event_ord"], r["source_txn_id"], r["op"], r["query"], r["committed_at"].second) for r in found.changes.orderBy("event_ord").collect()]
    assert rows == [(3, "g1", 1, "insert", 4), (4, "g1", 2, None, 4), (9, "log.1:110", 1, None, 9)]
    assert [r["event_ord"] for r in found.tail.orderBy("event_ord").collect()] == [11, 12]


def test_begin_clears_and_anonymous_is_no_identifier(spark):
    log = events(spark, ("GTID", {"gtid": "old"}), ("WRITE_ROWS_V2", {}), ("ANONYMOUS_GTID", {"gtid": "0"}), Q("BEGIN"), ("WRITE_ROWS_V2", {}), ("XID", {}))
    assert [(r["event_ord"], r["source_txn_id"]) for r in assemble(log).changes.collect()] == [(4, "log.1:105")]


def test_ddl_is_a_transaction_of_its_own_and_passes_the_table_filter(spark):
    log = events(spark, ("GTID", {"gtid": "g"}), Q(" ALTER TABLE x ADD y INT "), Q("BEGIN"), ("WRITE_ROWS_V2", {}), ("XID", {}))
    rows = assemble(log, Filter(("other",))).changes.collect()
    assert [(r["op"], r["query"], r["source_txn_id"]) for r in rows] == [(4, "ALTER TABLE x ADD y INT", "g")]


def test_unreadable_rows_are_misses_and_clear_the_statement(spark):
    log = events(spark, Q("BEGIN"), ("ROWS_QUERY", {"statement": "s"}), ("WRITE_ROWS_V2", {"skipped": [[1]]}), ("WRITE_ROWS_V2", {}), ("XID", {}))
    found = assemble(log)
    assert [(r["event_ord"], r["query"]) for r in found.changes.collect()] == [(3, None)]
    assert "partial" in found.misses.first()["reason"]


@pytest.mark.parametrize("bad", [("XA_PREPARE", {}), Q("xa commit 'x'")])
def test_xa_is_refused(spark, bad):
    with pytest.raises(Refused, match="XA"):
        assemble(events(spark, Q("BEGIN"), bad))


def test_payloads_are_unwrapped_in_order(spark):
    inner = events(spark, Q("BEGIN"), ("WRITE_ROWS_V2", {}), ("XID", {})).drop("stream", "sub_ord", "file_ord", "event_ord", "log_file", "log_pos")
    payload = inner.agg(F.collect_list(F.struct(*inner.columns)).alias("payload")).first()["payload"]
    kind = inner.agg(F.collect_list(F.struct(*inner.columns)).alias("p")).schema["p"].dataType
    outer = events(spark, ("GTID", {"gtid": "g9"}), ("TRANSACTION_PAYLOAD", {}))
    held = spark.createDataFrame([(1, payload)], f"event_ord long, payload {kind.simpleString()}")
    found = assemble(outer.join(held, "event_ord", "left")).changes.collect()
    assert [(r["source_txn_id"], r["op"], r["sub_ord"]) for r in found] == [("g9", 1, 2)]


def test_heartbeats_say_how_far_the_source_got(spark):
    log = events(spark, ("HEARTBEAT", {"event_at": datetime(1970, 1, 1, tzinfo=UTC)}))
    now = datetime(2024, 5, 5, tzinfo=UTC)
    assert assemble(log, clock=now).reached.select(F.unix_seconds("reached")).first()[0] == int(now.timestamp())


def test_positions_fall_back_to_the_scan(spark):
    log = events(spark, Q("BEGIN"), ("WRITE_ROWS_V2", {"log_pos": 0}), ("XID", {"log_pos": None}), stream=False)
    assert [r["log_pos"] for r in with_positions(log).orderBy("event_ord").collect()] == [100, 24, 34]


@pytest.mark.parametrize(
    ("kind", "change", "why"),
    [
        ("UPDATE_ROWS_V2", {"images": [[ROW]]}, "odd"),
        ("WRITE_ROWS_V2", {"names": None}, "column names"),
        ("WRITE_ROWS_V2", {"pk": [3]}, "out of range"),
        ("PARTIAL_UPDATE_ROWS", {}, "partial JSON"),
        ("WRITE_ROWS_V2", {"table_name": None}, "table map"),
    ],
)
def test_a_file_scan_refuses_what_it_cannot_read(spark, kind, change, why):
    with pytest.raises(Refused, match=why):
        file_changes(events(spark, (kind, change), stream=False), Filter(("elsewhere",)))


def test_files_are_read_in_the_order_named(spark, tmp_path):
    for i in (1, 2):
        events(spark, Q("BEGIN"), ("WRITE_ROWS_V2", {}), Q("DROP TABLE x"), ("UPDATE_ROWS_V2", {}), stream=False).withColumn("log_file", F.lit(f"log.{i}")).coalesce(1).write.json(str(tmp_path / f"{i}.json"))
    rows = read_changes(spark, [str(tmp_path / "2.json"), str(tmp_path / "1.json")]).orderBy("file_ord", "event_ord").collect()
    assert [(r["log_file"], r["op"]) for r in rows] == [("log.2", 1), ("log.2", 4), ("log.2", 2), ("log.1", 1), ("log.1", 4), ("log.1", 2)]
    assert (rows[2]["before"][0]["i"], rows[2]["after"][0]["i"]) == (1, 2)
    window = Filter((), datetime.fromtimestamp(T0.timestamp() + 1, UTC), datetime.fromtimestamp(T0.timestamp() + 2, UTC))
    assert read_changes(spark, [str(tmp_path / "1.json")], window).count() == 2
    with pytest.raises(Refused):
        read_changes(spark, [])


def test_fingerprint():
    assert DecodeOptions().fingerprint() == "v1;parse_time=true;exact_decimal=true;verify_checksum=true;tz=UTC"


def test_running_sums_do_not_depend_on_the_stretch(spark):
    rows = [(g, n * 3, n % 2, n) for g in ("a", None, "b") for n in range(50)]
    df = spark.createDataFrame(rows, "g string, at long, sub int, v long").repartition(5)
    want = sorted(((g, at, sum(x for h, b, _, x in rows if h == g and b <= at)) for g, at, _, _ in rows), key=repr)
    for stretch in (1, 7, 10**6):
        got = running_sum(df, F.col("v"), "total", ["g"], ["at", "sub"], stretch=stretch)
        assert got.columns == [*df.columns, "total"]
        assert sorted(map(tuple, got.select("g", "at", "total").collect()), key=repr) == want
    assert running_sum(df.where("false"), F.col("v"), "total", ["g"], ["at"]).collect() == []


def test_one_long_file_is_assembled_in_stretches(spark, monkeypatch):
    steps = [Q("BEGIN"), ("WRITE_ROWS_V2", {}), ("UPDATE_ROWS_V1", {"log_pos": 0}), ("XID", {}), Q("BEGIN"), ("DELETE_ROWS_V0", {}), Q("ROLLBACK")]
    log = events(spark, *(steps * 6)).cache()

    def found():
        changes = assemble(log).changes.select("event_ord", "source_txn_id", "op")
        return sorted(map(tuple, changes.collect())), sorted(map(tuple, with_positions(log).select("event_ord", "log_pos").collect()))

    whole = found()
    monkeypatch.setattr(running, "STRETCH", 5)
    assert found() == whole and len(whole[0]) == 12
