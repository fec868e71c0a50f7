"""A window of recorded changes in Parquet, versioned by small manifests.

A version is one JSON file that names every data folder it consists of; publishing is
the rename of a complete file to a name that must not exist, so readers see a version
whole or not at all, and a reader that resolved one keeps reading it until ``vacuum``, after
a time of grace, deletes what no kept version names.  Rows carry their transaction's columns,
so a scan joins nothing; each folder keeps its range of ids and commit times, so cursors,
bounds, pruning and the search for transactions delivered twice skip folders before they skip
row groups.  Missed changes are rows too; the manifest holds their number and range.
``compact`` merges the small folders of many appends.  All file access goes through Spark's
file systems; intermediate data lies in ``spark.checkpoint.dir``, or in the store's own
folder, which driver and executors share.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import Filter, Refused, matches
from ..functions.values import unrenderable
from ..model import CHANGE, CHANGE_COLUMNS, SCHEMA_CHANGE
from .coverage import MAX_STALENESS, Binding, Coverage, Gap, Miss, Report, bounds, check, integrity_problems

SCHEMA_VERSION = 1
DEFAULT_PAGE, MAX_PAGE = 100, 1000
#: Steps from each layout to the next; none yet.
MIGRATIONS: dict[int, object] = {}
STALE_CLAIM = 60
#: Readers of an older version may go on for so long.
GRACE = timedelta(hours=1)
#: Folders of fewer rows are merged once there are more than so many of them.
SMALL_FOLDER, SMALL_FOLDERS = 1_000_000, 16
MISS_SCHEMA = "moment timestamp, reason string"


def page_limit(limit: int) -> int:
    return DEFAULT_PAGE if limit <= 0 else min(limit, MAX_PAGE)


def settled(df: DataFrame, root: str) -> DataFrame:
    """``df`` written once, so that every later use sees the same rows in the same places."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or f"{root}/scratch")
    return df.checkpoint(eager=True)


def contiguous_ids(rows: DataFrame, order: list[str], name: str, base: int, root: str) -> DataFrame:
    """Number rows base+1, base+2, ... in ``order`` without passing them through one task.

    Rows are range-partitioned and written with their places; the offsets of the partitions
    (one number each) are summed on the driver.  ``order`` must be total for the numbers to
    be repeatable.
    """
    placed = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), root)
    part = F.shiftright("__at", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = {}, base
    for p in sorted(sizes):
        starts[p] = total
        total += sizes[p]
    if not starts:
        return rows.withColumn(name, F.lit(None).cast("long"))
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in starts.items() for x in kv]), part.cast("long"))
    return placed.withColumn(name, offset + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at")


def undelivered(changes: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """``changes`` (with is_ddl) without transactions that are stored, each row once.

    ``stored`` is (source_txn_id, is_ddl); a schema change may share its identifier with
    a transaction of rows, so the pair is the key.
    """
    key = ["source_txn_id", "is_ddl"]
    return changes.join(stored.select(*key), key, "left_anti").dropDuplicates([*key, *order])


class _Files:
    """The few file operations a store needs, on whatever system ``root`` lives."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a whole file under ``name``; false if that name is taken.

        A claim file, created only if it is not there, says who may rename the finished
        draft; a claim left by a writer that died is dropped after ``STALE_CLAIM`` seconds.
        """
        target, claim = self._at(name), self._at(f"{name}.claim")
        if self.fs.exists(target):
            return False
        try:
            self.fs.create(claim, False).close()
        except Exception as e:
            if "FileAlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
            if not self.fs.exists(target) and self.fs.exists(claim) and time.time() - self.fs.getFileStatus(claim).getModificationTime() / 1000 > STALE_CLAIM:
                self.fs.delete(claim, False)
            return False
        draft = self._at(f"{name}.draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        done = not self.fs.exists(target) and self.fs.rename(draft, target)
        if not done:
            self.fs.delete(draft, False)
        self.fs.delete(claim, False)
        return bool(done)

    def older(self, folder: str, age: timedelta) -> list[str]:
        """Names in ``folder`` that nobody has touched for ``age``."""
        at = self._at(folder)
        found = self.fs.listStatus(at) if self.fs.exists(at) else []
        return [x.getPath().getName() for x in found if time.time() - x.getModificationTime() / 1000 >= age.total_seconds()]

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def exists(self) -> bool:
        return self.fs.exists(self.path)


def _seconds(moment: datetime | None) -> int | None:
    return None if moment is None else int(moment.timestamp())


def _moment(seconds: int | None) -> datetime | None:
    return None if seconds is None else datetime.fromtimestamp(seconds, UTC)


EMPTY = {
    "schema_version": SCHEMA_VERSION, "folders": [], "txns": 0, "changes": 0, "coverage_from": None, "coverage_to": None,
    "max_staleness": int(MAX_STALENESS.total_seconds()), "retention": 0, "binding": None, "checkpoint": None, "gaps": [], "misses": [], "missed_from": None, "batches": {},
}


class Snapshot:
    """One version of a store: the gate and every row it hands out belong together."""

    def __init__(self, spark: SparkSession, root: str, version: int, manifest: dict):
        self.spark, self.root, self.version, self.manifest = spark, root, version, manifest

    @property
    def coverage(self) -> Coverage:
        m = self.manifest
        start = m["coverage_from"]
        if start is None and m["folders"]:
            start = min(f["first_at"] for f in m["folders"])
        return Coverage(_moment(start), _moment(m["coverage_to"]), timedelta(seconds=m["max_staleness"]), timedelta(seconds=m["retention"]))

    @property
    def gaps(self) -> list[Gap]:
        return [Gap(_moment(g["start"]), _moment(g["end"]), g["reason"]) for g in sorted(self.manifest["gaps"], key=lambda g: g["start"])]

    def missed(self, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """(moment, reason) of changes that were seen and could not be recorded, bounds included."""
        a, b = _seconds(start), _seconds(end)
        since = max((x for x in (a, self.manifest["missed_from"]) if x is not None), default=None)
        folders = [x["name"] for x in self.manifest["misses"] if (since is None or x["last"] >= since) and (b is None or x["first"] <= b)]
        if not folders:
            return self.spark.createDataFrame([], MISS_SCHEMA)
        rows = self.spark.read.schema(MISS_SCHEMA).parquet(*[f"{self.root}/{n}" for n in folders])
        moment = F.unix_seconds("moment")
        rows = rows if since is None else rows.where(moment >= since)
        return rows if b is None else rows.where(moment <= b)

    @property
    def misses(self) -> list[Miss]:
        found = self.missed().select(F.unix_seconds("moment").alias("t"), "reason").orderBy("t", "reason").collect()
        return [Miss(_moment(r["t"]), r["reason"]) for r in found]

    @property
    def binding(self) -> Binding | None:
        return Binding(**self.manifest["binding"]) if self.manifest["binding"] else None

    def _read(self, kind: str, folders: list[dict]) -> DataFrame:
        schema = CHANGE if kind == "changes" else TXN_SCHEMA
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f['name']}/{kind}" for f in folders])

    def changes(self, f: Filter | None = None, before: int = 0) -> DataFrame:
        """Recorded changes; no gate."""
        f = f or Filter()
        folders = [
            x for x in self.manifest["folders"]
            if (not before or x["first_id"] < before)
            and (f.start is None or x["last_at"] >= f.start.timestamp())
            and (f.end is None or x["first_at"] <= f.end.timestamp())
        ]
        rows = self._read("changes", folders).where(matches(f))
        return rows.where(F.col("change_id") < before) if before else rows

    def txns(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """Recorded transactions, of folders whose commit times meet ``first`` to ``last``."""
        folders = self.manifest["folders"]
        if first is not None and last is not None:
            folders = [x for x in folders if x["last_at"] >= first and x["first_at"] <= last]
        return self._read("txns", folders)

    def gate(self, f: Filter, now: datetime) -> None:
        """Refuse a window that is not covered whole; of the misses in it one row is read."""
        check(self.coverage, f, now, self.gaps)
        start, end = bounds(self.coverage, f)
        first = self.missed(start, end).select(F.unix_seconds("moment").alias("t"), "reason").orderBy("t", "reason").limit(1).collect()
        check(self.coverage, f, now, self.gaps, [Miss(_moment(r["t"]), r["reason"]) for r in first])

    def events(self, f: Filter | None = None, now: datetime | None = None) -> DataFrame:
        """Oldest first, behind the gate."""
        self.gate(f or Filter(), now or datetime.now(UTC))
        return self.changes(f).orderBy("change_id")

    def events_newest_first(self, f: Filter | None = None, now: datetime | None = None) -> Iterator[Row]:
        """Newest first, behind the gate, partition by partition."""
        self.gate(f or Filter(), now or datetime.now(UTC))
        return self.changes(f).orderBy(F.col("change_id").desc()).toLocalIterator()

    def change(self, change_id: int) -> DataFrame:
        """One change by id, or none; without a gate, as one change is never incomplete."""
        folders = [x for x in self.manifest["folders"] if x["first_id"] <= change_id <= x["last_id"]]
        return self._read("changes", folders).where(F.col("change_id") == change_id).limit(1)

    def page(self, f: Filter | None = None, before: int = 0, limit: int = 0, now: datetime | None = None) -> DataFrame:
        """The newest ``limit`` matching changes below the cursor ``before`` (0: none)."""
        self.gate(f or Filter(), now or datetime.now(UTC))
        return self.changes(f, before).orderBy(F.col("change_id").desc()).limit(page_limit(limit))

    def status(self, now: datetime) -> Report:
        c = self.coverage
        checkpoint = self.manifest["checkpoint"]
        problems = integrity_problems(self.txns(), self.changes(), _moment(checkpoint["updated_at"]) if checkpoint else None)
        return Report(c, now - c.end if c.end else timedelta(0), self.gaps, self.misses, self.binding, problems)


TXN_SCHEMA = "txn_id long, source_txn_id string, is_ddl boolean, committed_at timestamp, server_id long"


class ChangeStore:
    """Reads and publishes versions under ``root``."""

    def __init__(self, spark: SparkSession, root: str, *, create: bool = True):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = _Files(spark, self.root)
        if not create and not self._versions():
            raise Refused(f"there is no store at {root}")

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names("manifest") if n.endswith(".json"))

    def snapshot(self) -> Snapshot:
        versions = self._versions()
        if not versions:
            return Snapshot(self.spark, self.root, 0, json.loads(json.dumps(EMPTY)))
        manifest = json.loads(self.files.read(f"manifest/{versions[-1]:010d}.json"))
        found = manifest["schema_version"]
        if found > SCHEMA_VERSION:
            raise Refused(f"the store at {self.root} has layout {found}, newer than {SCHEMA_VERSION}, which is all this version reads")
        while found < SCHEMA_VERSION:
            manifest = MIGRATIONS[found](manifest)
            found = manifest["schema_version"]
        return Snapshot(self.spark, self.root, versions[-1], manifest)

    def _publish(self, change) -> Snapshot:
        """Apply ``change`` to the newest manifest; again if another writer was faster."""
        for _ in range(20):
            now = self.snapshot()
            manifest = json.loads(json.dumps(now.manifest))
            if change(manifest) is False:
                return now
            if self.files.create(f"manifest/{now.version + 1:010d}.json", json.dumps(manifest)):
                return self.snapshot()
        raise Refused(f"the store at {self.root} is being written by others all the time")

    # Settings

    def open_coverage(self, moment: datetime) -> None:
        """Mark where coverage begins; the first mark stays."""
        self._publish(lambda m: m.update(coverage_from=_seconds(moment)) if m["coverage_from"] is None else False)

    def set_max_staleness(self, allowed: timedelta) -> None:
        self._publish(lambda m: m.update(max_staleness=int(allowed.total_seconds())))

    def set_retention(self, kept: timedelta) -> None:
        self._publish(lambda m: m.update(retention=int(kept.total_seconds())))

    def advance_coverage(self, moment: datetime) -> None:
        """Move the high-water mark forward, never back."""
        self._publish(lambda m: m.update(coverage_to=_seconds(moment)) if (m["coverage_to"] or -1) < _seconds(moment) else False)

    def bind(self, binding: Binding) -> None:
        """Bind to a source for good; a second, different one is refused."""

        def change(m: dict):
            if m["binding"]:
                Binding(**m["binding"]).check(binding)
                return False
            m["binding"] = vars(binding)

        self._publish(change)

    def record_gap(self, start: datetime, end: datetime, reason: str) -> None:
        self._publish(lambda m: m["gaps"].append({"start": _seconds(start), "end": _seconds(end), "reason": reason}))

    def record_misses(self, misses: list[Miss]) -> None:
        if misses:
            held = self._miss_folder(self.spark.createDataFrame([(x.moment, x.reason) for x in misses], MISS_SCHEMA))
            self._publish(lambda m: m["misses"].append(held))

    def _miss_folder(self, misses: DataFrame) -> dict | None:
        """Write missed changes; what the manifest holds of them."""
        name = f"misses/{uuid.uuid4().hex}"
        misses.select("moment", "reason").write.parquet(f"{self.root}/{name}")
        t = F.unix_seconds("moment")
        facts = self.spark.read.schema(MISS_SCHEMA).parquet(f"{self.root}/{name}").agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("a"), F.max(t).alias("b")).first()
        return {"name": name, "n": facts["n"], "first": facts["a"], "last": facts["b"]} if facts["n"] else None

    # Rows

    def append(
        self,
        changes: DataFrame,
        *,
        order: list[str],
        checkpoint: dict | None = None,
        misses: DataFrame | None = None,
        reached: datetime | None = None,
        batch: tuple[str, int] | None = None,
    ) -> Snapshot:
        """Store transactions (``changes`` rows share source_txn_id, committed_at, server_id).

        One publication holds transactions, rows, misses, checkpoint and coverage.  A
        transaction already stored, by (source_txn_id, is schema change), is left out: it
        bears its commit time again, so only folders of that time are searched; a batch already published is a no-op; a value that no literal can express
        rejects its batch before anything is written.  ``order`` is the log's order.
        """
        at = self.snapshot()
        if batch and at.manifest["batches"].get(batch[0], -1) >= batch[1]:
            return at
        keyed = changes.withColumn("is_ddl", F.col("op") == SCHEMA_CHANGE)
        span = keyed.agg(F.unix_seconds(F.min("committed_at")).alias("a"), F.unix_seconds(F.max("committed_at")).alias("b")).first()
        fresh = undelivered(keyed, at.txns(span["a"], span["b"]), order).persist()
        try:
            return self._append(at, fresh, order, checkpoint, misses, reached, batch)
        finally:
            fresh.unpersist()

    def _append(self, at: Snapshot, fresh: DataFrame, order: list[str], checkpoint, misses, reached, batch) -> Snapshot:
        cannot = lambda image: F.coalesce(F.exists(image, lambda c: unrenderable(c).isNotNull()), F.lit(False))
        bad = fresh.where(cannot("before") | cannot("after")).select("source_txn_id").first()
        if bad:
            raise Refused(f"a value in transaction {bad['source_txn_id']} cannot be stored")
        key = ["source_txn_id", "is_ddl"]
        heads = fresh.groupBy(*key).agg(
            F.min(F.struct(*order)).alias("__first"), F.max("committed_at").alias("committed_at"), F.max("server_id").alias("server_id")
        )
        txns = contiguous_ids(heads, ["__first", *key], "txn_id", at.manifest["txns"], self.root)
        rows = fresh.drop("txn_id", "change_id", "committed_at", "server_id").join(txns.select(*key, "txn_id", "committed_at", "server_id"), key)
        rows = contiguous_ids(rows, ["txn_id", *order], "change_id", at.manifest["changes"], self.root)
        name = f"data/{at.version + 1:010d}-{uuid.uuid4().hex}"
        facts = rows.agg(
            F.count(F.lit(1)).alias("n"), F.min("change_id").alias("a"), F.max("change_id").alias("b"), F.unix_seconds(F.min("committed_at")).alias("c"), F.unix_seconds(F.max("committed_at")).alias("d"), F.max("txn_id").alias("t"),
        ).first()
        if facts["n"]:
            rows.select(*CHANGE_COLUMNS).sortWithinPartitions("change_id").write.parquet(f"{self.root}/{name}/changes")
            txns.select("txn_id", *key, "committed_at", "server_id").write.parquet(f"{self.root}/{name}/txns")

        missed = None if misses is None else self._miss_folder(misses)

        def change(m: dict):
            if batch:
                if m["batches"].get(batch[0], -1) >= batch[1]:
                    return False
                m["batches"][batch[0]] = batch[1]
            if facts["n"]:
                if m["changes"] != at.manifest["changes"]:
                    raise Refused("another writer appended meanwhile; one collector at a time")
                m["folders"].append({"name": name, "first_id": facts["a"], "last_id": facts["b"], "first_at": facts["c"], "last_at": facts["d"]})
                m["changes"], m["txns"] = facts["b"], facts["t"]
            highest = [x for x in (m["coverage_to"], facts["d"] if facts["n"] else None, _seconds(reached)) if x is not None]
            m["coverage_to"] = max(highest) if highest else None
            if missed:
                m["misses"].append(missed)
            if checkpoint:
                m["checkpoint"] = checkpoint

        return self._publish(change)

    def prune(self, now: datetime) -> int:
        """Drop what lies before the retention edge; how many transactions went.

        Folders wholly behind the edge are left out, straddling ones rewritten, and the
        start of coverage moves to the edge in the same publication; ``vacuum`` then takes
        them off the disk.  No retention: everything stays.
        """
        at = self.snapshot()
        kept_for = at.manifest["retention"]
        if kept_for <= 0:
            return 0
        edge = _seconds(now) - kept_for
        moment = F.lit(_moment(edge))
        replaced: dict[str, dict | None] = {}
        removed = 0
        for f in at.manifest["folders"]:
            if f["first_at"] >= edge:
                continue
            txns = at._read("txns", [f])
            removed += txns.where(F.col("committed_at") < moment).count()
            if f["last_at"] < edge:
                replaced[f["name"]] = None
                continue
            rows = at._read("changes", [f]).where(F.col("committed_at") >= moment)
            name = f"data/{at.version + 1:010d}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{name}/changes")
            txns.where(F.col("committed_at") >= moment).write.parquet(f"{self.root}/{name}/txns")
            facts = rows.agg(F.min("change_id").alias("a"), F.unix_seconds(F.min("committed_at")).alias("c")).first()
            replaced[f["name"]] = f | {"name": name, "first_id": facts["a"], "first_at": facts["c"]}

        def change(m: dict):
            m["folders"] = [r for f in m["folders"] if (r := replaced.get(f["name"], f)) is not None]
            m["gaps"] = [g for g in m["gaps"] if g["end"] >= edge]
            m["misses"] = [x for x in m["misses"] if x["last"] >= edge]
            m["missed_from"] = edge
            m["coverage_from"] = max(edge, m["coverage_from"] if m["coverage_from"] is not None else edge)

        self._publish(change)
        return removed

    def compact(self, *, small: int | None = SMALL_FOLDER, most: int = SMALL_FOLDERS) -> int:
        """Merge runs of adjacent folders of fewer than ``small`` rows (None: of any number)
        once there are more than ``most`` of them; how many folders went into others."""
        at = self.snapshot()
        runs: list[list[dict]] = [[]]
        for f in sorted(at.manifest["folders"], key=lambda f: f["first_id"]):
            if small is None or f["last_id"] - f["first_id"] + 1 < small:
                runs[-1].append(f)
            else:
                runs.append([])
        if sum(map(len, runs)) <= most:
            return 0
        merged: dict[str, dict | None] = {}
        for run in runs:
            if len(run) < 2:
                continue
            name = f"data/{at.version + 1:010d}-{uuid.uuid4().hex}"
            parts = max(1, (run[-1]["last_id"] - run[0]["first_id"] + 1) // (small or SMALL_FOLDER))
            at._read("changes", run).repartitionByRange(parts, "change_id").sortWithinPartitions("change_id").write.parquet(f"{self.root}/{name}/changes")
            at._read("txns", run).coalesce(parts).write.parquet(f"{self.root}/{name}/txns")
            whole = {"name": name, "first_id": run[0]["first_id"], "last_id": run[-1]["last_id"], "first_at": min(f["first_at"] for f in run), "last_at": max(f["last_at"] for f in run)}
            merged |= {f["name"]: None for f in run[1:]} | {run[0]["name"]: whole}

        def change(m: dict):
            if not set(merged) <= {f["name"] for f in m["folders"]}:
                return False  # pruned meanwhile
            m["folders"] = [r for f in m["folders"] if (r := merged.get(f["name"], f)) is not None]

        self._publish(change)
        return len(merged)

    def vacuum(self, grace: timedelta = GRACE) -> int:
        """Delete old versions, and folders that no kept version names, if nobody has touched
        them for ``grace``; how many were deleted."""
        versions = self._versions()
        old = set(self.files.older("manifest", grace))
        kept = [v for v in versions if v == versions[-1] or f"{v:010d}.json" not in old]
        named = set()
        for v in kept:
            m = json.loads(self.files.read(f"manifest/{v:010d}.json"))
            named |= {f["name"] for f in m["folders"]} | {x["name"] for x in m["misses"]} | {(m["checkpoint"] or {}).get("tail")}
        gone = [f"manifest/{v:010d}.json" for v in versions if v not in kept]
        gone += [f"{kind}/{n}" for kind in ("data", "misses", "tail") for n in self.files.older(kind, grace) if f"{kind}/{n}" not in named]
        for name in gone:
            self.files.delete(name)
        return len(gone)
