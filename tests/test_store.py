import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rowtide.api import Api, is_loopback, serve
from rowtide.cli import main
from rowtide.functions.predicates import BadRequest, Filter, Refused
from rowtide.operators.timeline import one, page
from rowtide.plans.claim import Claim
from rowtide.plans.coverage import Binding, Coverage, Gap, Miss, check
from rowtide.plans.script import render, script_frame, script_lines, write_blocks, write_lines
from rowtide.plans.store import ChangeStore, page_limit
from rowtide.sources.fixture import changes
from rowtide.streaming.collector import Collector, read_stream

from test_log import Q, events

NOW = datetime(2024, 1, 31, 0, 0, tzinfo=UTC)


@pytest.fixture(scope="module")
def log(spark):
    return changes(spark, "/root/testdata/sf0.001").withColumn("ord", F.col("change_id")).cache()


@pytest.fixture
def store(spark, log, tmp_path):
    s = ChangeStore(spark, str(tmp_path / "store"))
    s.append(log.where("txn_id < 20"), order=["ord"], batch=("t", 0), checkpoint={"log_file": "binlog.000001", "log_pos": 4, "gtid": None, "updated_at": 0})
    return s


def now_of(store):
    return store.snapshot().coverage.end + timedelta(seconds=10)


def test_append_numbers_in_order_and_replays_change_nothing(store, log):
    first = store.snapshot()
    rows = first.changes().orderBy("change_id").collect()
    assert [r["change_id"] for r in rows] == list(range(1, len(rows) + 1))
    assert [r["source_txn_id"] for r in rows] == [r["source_txn_id"] for r in log.where("txn_id < 20").orderBy("ord").collect()]
    assert store.append(log.where("txn_id < 20"), order=["ord"], batch=("t", 0)).version == first.version
    again = store.append(log.where("txn_id < 30"), order=["ord"], batch=("t", 1))
    assert again.changes().count() == log.where("txn_id < 30").count()
    assert first.changes().count() == len(rows)  # an old version stays as it was
    both = store.append(log.where("txn_id between 40 and 41").unionByName(log.where("txn_id = 41")), order=["ord"], batch=("t", 2))
    assert both.changes().count() == again.changes().count() + log.where("txn_id between 40 and 41").count()


def test_a_bad_value_rejects_the_whole_batch(store, log):
    struct = lambda c: F.struct(*[F.lit("1 OR 1").alias("raw") if f == "raw" else c[f].alias(f) for f in ("tag", "i", "u", "f", "d", "b", "bin", "t", "raw")])
    bad = log.where("txn_id = 50").withColumn("after", F.transform("after", lambda c: F.when(c["raw"].isNotNull(), struct(c)).otherwise(c)))
    before = store.snapshot().version
    with pytest.raises(Refused):
        store.append(log.where("txn_id = 49").unionByName(bad), order=["ord"])
    assert store.snapshot().version == before


def test_pages_and_lookup(store):
    s, now = store.snapshot(), now_of(store)
    n = s.changes().count()
    seen, cursor = [], 0
    while True:
        got = page(s, Filter(), cursor, 20, now)
        seen += [c["id"] for c in got["changes"]]
        if "next" not in got:
            break
        cursor = got["next"]
    assert seen == list(range(n, 0, -1))
    assert [page_limit(x) for x in (-1, 0, 5, 5000)] == [100, 100, 5, 1000]
    wallets = page(s, Filter(("SHOP.wallets",)), 0, 5, now)["changes"]
    assert len(wallets) == 5 and {c["table"] for c in wallets} == {"wallets"}
    assert one(s, 1)["after"][0].isdigit() and one(s, 10**6) is None
    assert [r["change_id"] for r in s.events_newest_first(now=now)] == seen
    assert s.events(now=now).first()["change_id"] == 1


@pytest.mark.parametrize(
    ("coverage", "f", "gaps", "misses", "why"),
    [
        (Coverage(), Filter(), [], [], "no coverage"),
        (Coverage(NOW - timedelta(days=2), NOW - timedelta(minutes=6)), Filter(), [], [], "stale"),
        (Coverage(NOW - timedelta(days=2), NOW), Filter((), NOW - timedelta(days=3)), [], [], "before coverage"),
        (Coverage(NOW - timedelta(days=2), NOW), Filter((), None, NOW + timedelta(minutes=6)), [], [], "past coverage"),
        (Coverage(NOW - timedelta(days=2), NOW), Filter(), [Gap(NOW - timedelta(days=1), NOW - timedelta(hours=20), "lost")], [], "gap"),
        (Coverage(NOW - timedelta(days=2), NOW), Filter((), NOW - timedelta(hours=20)), [Gap(NOW - timedelta(days=1), NOW - timedelta(hours=20), "lost")], [], "gap"),
        (Coverage(NOW - timedelta(days=2), NOW), Filter((), None, NOW - timedelta(hours=1)), [], [Miss(NOW - timedelta(hours=1), "odd")], "unrecorded"),
        (Coverage(NOW - timedelta(days=2), NOW), Filter((), NOW - timedelta(hours=1), NOW + timedelta(minutes=5)), [Gap(NOW - timedelta(days=1), NOW - timedelta(hours=20), "x")], [], None),
    ],
)
def test_the_gate(coverage, f, gaps, misses, why):
    if why is None:
        check(coverage, f, NOW, gaps, misses)
    else:
        with pytest.raises(Refused, match=why):
            check(coverage, f, NOW, gaps, misses)


def test_an_inverted_window_is_refused():
    with pytest.raises(BadRequest):
        Filter((), NOW, NOW - timedelta(seconds=1))


def test_metadata(store):
    store.open_coverage(NOW)
    store.open_coverage(NOW - timedelta(days=9))
    assert store.snapshot().coverage.start == NOW
    high = store.snapshot().coverage.end
    store.advance_coverage(high - timedelta(days=1))
    assert store.snapshot().coverage.end == high
    b = Binding("mysql", "mysql:u", "", "v1")
    store.bind(b)
    store.bind(b)
    with pytest.raises(Refused, match="flavor"):
        store.bind(Binding("mariadb", "mysql:u", "", "v1"))
    store.record_gap(NOW, NOW, "g")
    assert store.snapshot().gaps[0].reason == "g"


def test_prune_moves_the_edge(store, log):
    store.append(log.where("txn_id >= 20"), order=["ord"], batch=("t", 1))
    rows = store.snapshot().changes()
    t = sorted(r[0] for r in rows.select(F.unix_seconds("committed_at")).collect())
    edge = t[len(t) // 2]
    assert store.prune(NOW) == 0  # without a retention everything stays
    store.record_gap(datetime.fromtimestamp(edge - 50, UTC), datetime.fromtimestamp(edge - 1, UTC), "old")
    store.record_gap(datetime.fromtimestamp(edge - 50, UTC), datetime.fromtimestamp(edge, UTC), "straddles")
    store.set_retention(timedelta(days=1))
    gone = store.prune(datetime.fromtimestamp(edge + 86400, UTC))
    s = store.snapshot()
    assert gone > 0 and s.changes().count() == sum(x >= edge for x in t)
    assert s.coverage.start == datetime.fromtimestamp(edge, UTC)
    assert [g.reason for g in s.gaps] == ["straddles"]
    assert s.status(NOW).problems == []


def test_vacuum_takes_off_the_disk_what_no_version_names(spark, store, log):
    old = store.snapshot()
    store.append(log.where("txn_id >= 20"), order=["ord"], batch=("t", 1))
    store.record_misses([Miss(NOW, "kept"), Miss(NOW - timedelta(days=9), "old")])
    store.set_retention(timedelta(days=1))
    store.prune(store.snapshot().coverage.end)
    assert store.vacuum() == 0 and old.changes().count()  # within the time of grace nothing goes
    assert store.vacuum(timedelta(0)) > 0 and store.vacuum(timedelta(0)) == 0
    now = store.snapshot()
    named = {f["name"] for f in now.manifest["folders"]}
    assert {f"data/{n}" for n in store.files.names("data")} == named
    assert spark.read.parquet(f"{store.root}/data/*/changes").count() == now.changes().count() < log.count()
    assert now.version == store._versions()[0] and {m.reason for m in now.misses} == {"kept"}


def test_compaction_keeps_rows_ids_and_times(store, log):
    for i in range(4):
        store.append(log.where(f"txn_id between {20 + 5 * i} and {24 + 5 * i}"), order=["ord"], batch=("t", i + 1))
    before = sorted(map(tuple, store.snapshot().changes().select("change_id", "txn_id", "source_txn_id").collect()))
    covered = store.snapshot().coverage
    assert store.compact() == 0 and store.compact(most=4) == 5
    after = store.snapshot()
    assert len(after.manifest["folders"]) == 1 and after.coverage == covered
    assert sorted(map(tuple, after.changes().select("change_id", "txn_id", "source_txn_id").collect())) == before
    assert after.txns().count() == len({t for _, t, _ in before})
    again = store.append(log.where("txn_id < 45"), order=["ord"], batch=("t", 9))  # delivered once more
    assert again.changes().count() == log.where("txn_id < 45").count()


def test_folders_of_any_size_are_merged_where_asked(store, log, monkeypatch):
    """What is no small folder to ``compact`` stays, unless all are to be one folder."""
    store.append(log.where("txn_id between 20 and 24"), order=["ord"], batch=("t", 1))
    before = sorted(map(tuple, store.snapshot().changes().select("change_id", "txn_id", "source_txn_id").collect()))
    folders = len(store.snapshot().manifest["folders"])
    assert folders > 1 and store.compact(small=1, most=1) == 0
    monkeypatch.setattr("rowtide.plans.store.SMALL_FOLDER", 10)
    assert store.compact(small=None, most=1) == folders
    after = store.snapshot()
    assert len(after.manifest["folders"]) == 1 and after.txns().count() == len({t for _, t, _ in before})
    assert sorted(map(tuple, after.changes().select("change_id", "txn_id", "source_txn_id").collect())) == before


def test_old_folders_are_not_searched_for_duplicates(store, log):
    late = log.where("txn_id >= 100")
    span = late.agg(F.unix_seconds(F.min("committed_at")), F.unix_seconds(F.max("committed_at"))).first()
    assert store.snapshot().txns(*span).count() == 0 and store.snapshot().txns().count() > 0


def test_a_version_has_one_writer(store):
    v = store.snapshot().version + 1
    name = f"manifest/{v:010d}.json"
    held = store.files.fs.create(store.files._at(f"{name}.claim"), False)
    held.close()
    assert not store.files.create(name, "{}") and store.snapshot().version == v - 1  # claimed by another
    store.files.delete(f"{name}.claim")
    assert store.files.create(name, json.dumps(store.snapshot().manifest)) and not store.files.create(name, "{}")
    assert store.snapshot().version == v


def test_status_and_integrity(store, spark, tmp_path):
    now = now_of(store)
    report = store.snapshot().status(now)
    assert report.healthy() and report.problems == []
    store.append(store.snapshot().changes().limit(0).withColumn("ord", F.lit(1)), order=["ord"], checkpoint={"log_file": "x", "log_pos": 1, "gtid": None, "updated_at": int(NOW.timestamp()) + 10**8})
    assert "ahead" in store.snapshot().status(now).verdict()
    assert "no coverage" in ChangeStore(spark, str(tmp_path / "none")).snapshot().status(now).verdict()
    with pytest.raises(Refused):
        ChangeStore(spark, str(tmp_path / "none"), create=False)


def test_newer_layouts_are_refused(store):
    v = store.snapshot().version
    store.files.create(f"manifest/{v + 1:010d}.json", json.dumps(store.snapshot().manifest | {"schema_version": 99}))
    with pytest.raises(Refused, match="layout 99"):
        store.snapshot()


def test_http(store):
    now = now_of(store)
    api = Api(store, "the store", clock=lambda: now)
    get = lambda t, m="GET", **k: api.respond(m, t, **k)
    assert json.loads("".join(get("/api/status")[2]))["healthy"] is True
    assert len(json.loads("".join(get("/api/changes?limit=3")[2]))["changes"]) == 3
    assert get("/api/changes?limit=lots")[0] == 400 and get("/api/changes?from=2024-02-01&to=2024-01-01")[0] == 400
    assert get("/api/changes?from=2001-01-01")[0] == 409 and get("/api/revert.sql?from=2001-01-01")[0] == 409
    assert get("/api/changes/1")[0] == 200 and get("/api/changes/99999")[0] == 404 and get("/api/changes/x")[0] == 400
    assert get("/nowhere")[0] == 404 and get("/api/status", "POST")[0] == 405 and list(get("/api/status", "HEAD")[2]) == []
    status, headers, body = get("/api/revert.sql?tables=wallets&generated=nothing")
    text = "".join(body)
    assert status == 200 and "attachment" in headers["Content-Disposition"] and "-- end of script: " in text and "`accounts`" not in text
    locked = Api(store, "x", token="secret", clock=lambda: now)
    assert locked.respond("GET", "/api/status")[0] == 401 and locked.respond("GET", "/api/status", "Bearer secret")[0] == 200
    with pytest.raises(ValueError):
        Api(store, "x", token="")
    assert [is_loopback(h) for h in ("127.0.0.1", "::1", "localhost", "", "0.0.0.0", "db.example")] == [True, True, True, False, False, False]
    with pytest.raises(Refused):
        serve(api, "0.0.0.0", 0)


def test_scripts_are_whole_or_absent(store, tmp_path):
    path = tmp_path / "out.sql"
    s = store.snapshot()
    write_lines(script_lines(s.changes(), "x\ny"), str(path))
    lines = path.read_text().splitlines()
    assert lines[1] == "-- source: <unprintable, 3 bytes>" and lines[-1] == f"-- end of script: {s.changes().count()} statements"
    assert all(x == "" or x.startswith(("-- ", "SET ", "DELETE ", "UPDATE ", "INSERT ")) for x in lines)
    assert path.stat().st_mode & 0o777 == 0o600
    with pytest.raises(Refused):
        write_lines(["x"], str(path))

    frame = script_frame(s.changes(), "x\ny").orderBy("part", F.col("place").desc(), "at")
    assert [r["line"] for r in frame.collect()] == lines

    def broken():
        yield "first"
        raise RuntimeError

    with pytest.raises(RuntimeError):
        write_lines(broken(), str(path), force=True)
    assert path.read_text().splitlines() == lines and list(tmp_path.glob(".*partial*")) == []
    whole = render(s.changes(Filter(("wallets",))), "x", Filter(("wallets",))).splitlines()
    n = s.changes(Filter(("wallets",))).count()
    assert f"-- {n} statements, newest change first" in whole and whole[-1] == f"-- end of script: {n} statements"
    write_blocks(s.changes(), str(tmp_path / "parts"))
    assert (tmp_path / "parts" / "_SUCCESS").exists()
    assert [r["line"] for r in script_frame(s.changes(Filter(("nothing",))), "x").where("part = 2").collect()] == ["-- no matching changes found"]
    empty = list(script_lines(s.changes(Filter(("nothing",))), "x"))
    assert empty[-1] == "-- no matching changes found"


def test_one_collector_at_a_time(tmp_path):
    with Claim(str(tmp_path / "lock")):
        with pytest.raises(Refused):
            Claim(str(tmp_path / "lock"))
    Claim(str(tmp_path / "lock")).release()


def test_the_collector_keeps_open_transactions_and_misses(spark, tmp_path):
    store = ChangeStore(spark, str(tmp_path / "s"))
    c = Collector(store, clock=lambda: NOW)
    first = events(spark, Q("BEGIN"), ("WRITE_ROWS_V2", {}), ("XID", {}), Q("BEGIN"), ("WRITE_ROWS_V2", {}), ("WRITE_ROWS_V2", {"skipped": [[0]]}))
    c.process(first, 0)
    s = store.snapshot()
    assert s.changes().count() == 1 and len(s.misses) == 1
    second = events(spark, ("XID", {"event_ord": 6, "log_pos": 106}))
    c.process(second, 1)
    c.process(second, 1)  # replayed
    rows = store.snapshot().changes().orderBy("change_id").collect()
    assert [(r["change_id"], r["source_txn_id"]) for r in rows] == [(1, "log.1:102"), (2, "log.1:106")]
    c.lost_position(NOW - timedelta(hours=1))
    assert store.snapshot().gaps[0].end == NOW


def test_streaming_and_the_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "log"
    folder.mkdir()
    events(spark, Q("BEGIN"), ("WRITE_ROWS_V2", {}), ("UPDATE_ROWS_V2", {}), ("XID", {})).coalesce(1).write.mode("append").json(str(folder))
    root = str(tmp_path / "s")
    assert main(["watch", "--store", root, "--log", str(folder), "--once", "--retention-days", "0"], spark) == 0
    assert ChangeStore(spark, root).snapshot().changes().count() == 2
    at = datetime(2024, 1, 1, 0, 0, 30, tzinfo=UTC)
    ChangeStore(spark, root)._publish(lambda m: m.update(coverage_from=int(at.timestamp()) - 60, coverage_to=int(at.timestamp())))
    assert main(["status", "--store", root], spark, at) == 0
    assert main(["status", "--store", root, "--json"], spark, at + timedelta(hours=1)) == 1
    assert main(["status", "--store", str(tmp_path / "no")], spark, at) == 1
    out = tmp_path / "r.sql"
    assert main(["generate", "--store", root, "--out", str(out)], spark, at) == 0
    assert "UPDATE `shop`.`orders` SET `id` = 1 WHERE `id` = 2 LIMIT 1;" in out.read_text()
    assert main(["generate", "--store", root, "--out", str(out)], spark, at) == 2
    assert main(["generate"], spark, at) == 2 and main(["nonsense"], spark) == 2 and main(["version"]) == 0 and main([]) == 2
    assert main(["serve", "--store", root, "--host", "0.0.0.0"], spark) == 2
    capsys.readouterr()
    assert read_stream(spark, str(folder)).isStreaming
