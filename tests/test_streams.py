import json

import pytest

from rowtide.functions.predicates import Refused
from rowtide.plans.store import ChangeStore
from rowtide.sources.decoded_log import LogLines, LogLinesReader, parse_lines
from rowtide.streaming.collector import Collector, keep_running, read_stream
from test_log import Q, events


def test_positions_of_growing_and_rotated_files(tmp_path):
    (tmp_path / "log.1.jsonl").write_text("a\nbé\nhalf")
    for split in (1, 3, 1 << 20):
        r = LogLinesReader(str(tmp_path), split=split)
        assert r.latestOffset() == {"file": "log.1.jsonl", "at": 6}
        assert lines(r, r.initialOffset(), r.latestOffset()) == [("log.1.jsonl", 0, "a"), ("log.1.jsonl", 2, "bé")]
    at = r.latestOffset()
    assert lines(r, at, r.latestOffset()) == []  # a line without its end waits
    with open(tmp_path / "log.1.jsonl", "a") as f:
        f.write(" done\n")
    (tmp_path / "log.2.jsonl").write_text("\nc\n" + "x" * 200_000)
    end = r.latestOffset()
    assert end == {"file": "log.2.jsonl", "at": 3}
    assert lines(r, at, end) == [("log.1.jsonl", 6, "half done"), ("log.2.jsonl", 0, ""), ("log.2.jsonl", 1, "c")]
    assert LogLinesReader(str(tmp_path), "latest").initialOffset() == end
    assert LogLinesReader(tmp_path.as_uri()).latestOffset() == end
    (tmp_path / "log.2.jsonl").write_text("")
    with pytest.raises(Refused, match="gap"):
        r.partitions(end, end)
    (tmp_path / "log.2.jsonl").unlink()
    with pytest.raises(Refused, match="gap"):
        r.partitions(end, end)
    assert LogLinesReader(str(tmp_path / "sub")).folder and LogLinesReader(str(tmp_path)).partitions({"file": "", "at": 0}, {"file": "", "at": 0}) == []


def lines(reader, start, end):
    return [row for p in reader.partitions(start, end) for row in reader.read(p)]


def test_the_line_source_feeds_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = json.dumps({"log_file": "log.1", "file_ord": 0, "event_ord": 0, "event_type": "QUERY", "statement": "BEGIN"})
    (folder / "log.1.jsonl").write_text(line + "\n" + line.replace("BEGIN", "COMMIT") + "\n")
    spark.dataSource.register(LogLines)
    stream = spark.readStream.format("rowtide_log").option("path", str(folder)).load()
    seen = []
    query = stream.writeStream.foreachBatch(lambda df, n: seen.extend(parse_lines(df).collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    query.processAllAvailable()
    query.stop()
    assert [r["statement"] for r in seen] == ["BEGIN", "COMMIT"]


def test_a_refusal_ends_the_loop_and_a_failure_does_not(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    events(spark, Q("BEGIN"), ("WRITE_ROWS_V2", {}), ("XID", {})).coalesce(1).write.mode("append").json(str(folder))
    store = ChangeStore(spark, str(tmp_path / "s"))
    collector = Collector(store)
    process, tries = collector.process, []

    def fragile(df, n):
        tries.append(n)
        if len(tries) == 1:
            raise RuntimeError("the connection broke")
        process(df, n)

    collector.process = fragile
    keep_running(lambda: collector.start(read_stream(spark, str(folder)), str(tmp_path / "c")), backoff=0.1, every=1)
    assert tries[:2] == [0, 0] and store.snapshot().changes().count() == 1
    events(spark, ("XA_PREPARE", {"event_ord": 9})).coalesce(1).write.mode("append").json(str(folder))
    with pytest.raises(Refused, match="XA"):
        keep_running(lambda: collector.start(read_stream(spark, str(folder)), str(tmp_path / "c")), backoff=0.1, every=1)
    assert store.snapshot().changes().count() == 1
