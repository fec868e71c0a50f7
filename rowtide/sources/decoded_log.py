"""Decoded logs in JSON lines or Parquet, in batch and as a position-tracking stream."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.predicates import Filter, Refused
from ..operators.normalise import EVENT_SCHEMA, file_changes

#: Bytes that one task reads of a growing file, and that the driver reads from its end at once.
SPLIT, BEHIND = 64 << 20, 64 << 10


@dataclass(frozen=True)
class DecodeOptions:
    """What a decoder must have done; bound to a store, so two decoders never mix."""

    parse_time: bool = True
    exact_decimal: bool = True
    verify_checksum: bool = True
    timezone: str = "UTC"

    def fingerprint(self) -> str:
        flag = lambda b: str(b).lower()
        return f"v1;parse_time={flag(self.parse_time)};exact_decimal={flag(self.exact_decimal)};verify_checksum={flag(self.verify_checksum)};tz={self.timezone}"


def read_events(spark: SparkSession, files: list[str]) -> DataFrame:
    """Decoded events of log files, in the order the files are named."""
    if not files:
        raise Refused("no log file was named")
    parts = []
    for i, path in enumerate(files):
        reader = spark.read.schema(EVENT_SCHEMA)
        part = reader.json(path, mode="FAILFAST") if path.endswith((".json", ".jsonl")) else reader.parquet(path)
        parts.append(part.withColumn("file_ord", F.lit(i)))
    return reduce(DataFrame.unionByName, parts)


def read_changes(spark: SparkSession, files: list[str], f: Filter | None = None) -> DataFrame:
    """Changes of all files, filtered; any unreadable row event refuses the scan."""
    return file_changes(read_events(spark, files), f)


class LogLines(DataSource):
    """Stream of decoded events from JSON lines files that grow and rotate by name.

    The offset is {file, at}, a byte position: what a restarted query resumes from, and all
    that the driver looks at; executors read the lines, in ranges of ``SPLIT`` bytes.  The
    folder may lie on any file system that Arrow reads.  Register with
    ``spark.dataSource.register(LogLines)``, then ``readStream.format("rowtide_log")``.
    """

    @classmethod
    def name(cls) -> str:
        return "rowtide_log"

    def schema(self) -> str:
        return "log_file string, at long, event string"

    def streamReader(self, schema) -> LogLinesReader:
        return LogLinesReader(self.options["path"], self.options.get("start", "earliest"))


@dataclass
class LineRange(InputPartition):
    """Lines of ``file`` that begin at ``start`` or behind it and before ``stop``."""

    file: str
    start: int
    stop: int


class LogLinesReader(DataSourceStreamReader):
    """Without a checkpoint it starts at the first line, or with start=latest at the end:
    a source that was never followed is followed from now on.  A line without its end waits."""

    def __init__(self, folder: str, start: str = "earliest", split: int = SPLIT):
        self.folder, self.start, self.split = folder, start, split

    def _place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), os.path.abspath(self.folder))

    def _sizes(self) -> dict[str, int]:
        from pyarrow import fs

        system, base = self._place()
        found = system.get_file_info(fs.FileSelector(base))
        return {x.base_name: x.size for x in sorted(found, key=lambda x: x.base_name) if x.is_file and x.base_name.endswith(".jsonl")}

    def _whole(self, name: str, size: int) -> int:
        """Bytes of a file up to and with its last line feed, read from behind."""
        system, base = self._place()
        with system.open_input_file(f"{base}/{name}") as f:
            end = size
            while end > 0:
                begin = max(0, end - BEHIND)
                f.seek(begin)
                at = f.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.start == "latest" else {"file": "", "at": 0}

    def latestOffset(self) -> dict:
        sizes = self._sizes()
        if not sizes:
            return {"file": "", "at": 0}
        name = max(sizes)
        return {"file": name, "at": self._whole(name, sizes[name])}

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        sizes = self._sizes()
        if start["file"] and sizes.get(start["file"], -1) < start["at"]:
            raise Refused(f"{start['file']}:{start['at']}, the position to resume from, is gone; record a gap and start anew")
        out = []
        for name, size in sizes.items():
            if start["file"] <= name <= end["file"]:
                first = start["at"] if name == start["file"] else 0
                stop = end["at"] if name == end["file"] else self._whole(name, size)
                out += [LineRange(name, at, min(at + self.split, stop)) for at in range(first, stop, self.split)]
        return out

    def read(self, partition: LineRange) -> Iterator[tuple[str, int, str]]:
        system, base = self._place()
        with io.BufferedReader(system.open_input_file(f"{base}/{partition.file}")) as f:
            # A line that begins before the range belongs to the range before.
            at = max(0, partition.start - 1)
            f.seek(at)
            if partition.start:
                at += len(f.readline())
            while at < partition.stop:
                line = f.readline()
                yield partition.file, at, line.rstrip(b"\n").decode("utf-8")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


def parse_lines(lines: DataFrame) -> DataFrame:
    """Events out of ``LogLines`` rows."""
    return lines.select(F.from_json("event", EVENT_SCHEMA, {"mode": "FAILFAST"}).alias("e")).select("e.*")


