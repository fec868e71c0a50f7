"""Small helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import warnings
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch.  Texts may be long, so batches stay short.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a whole table through Spark, so that any store Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; one of our own only where none is set."""
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        warnings.warn("spark.checkpoint.dir is not set; using a folder of this machine, which no cluster shares", stacklevel=2)
        shared = tempfile.mkdtemp(prefix="rowtide-checkpoint-")
    context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate rows that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's switch for the deletion of a query's shuffle files as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there (survives lost executors).

    What was shuffled for it is deleted at once, not when the driver happens to collect
    its garbage: nothing reads it again.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return _guessed_anew(df.select("*").checkpoint(eager=True))  # the switch holds for plans made from now on
    finally:
        spark.conf.set(CLEANUP, before)


def _guessed_anew(df: DataFrame) -> DataFrame:
    """``df`` (of ``cut``) without a guess of its size that is beyond all bounds.

    What is written apart inherits the guess for its plan, a product over all joins before
    it.  In rounds of joins the guess gets four times as many digits a round, until planning
    takes longer than the work.
    """
    held = df._jdf.queryExecution().logical()
    if held.stats().sizeInBytes().bit_length() < 63:
        return df
    jvm, session, none = df.sparkSession._jvm, df.sparkSession._jsparkSession, df.sparkSession._jvm.scala.Option.empty()
    plan = jvm.org.apache.spark.sql.execution.LogicalRDD(
        held.output(), held.rdd(), held.outputPartitioning(), held.outputOrdering(), held.isStreaming(), held.stream(), session, none, none
    )
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plan), df.sparkSession)


def forget(*frames: DataFrame) -> None:
    """Delete what ``cut`` wrote of frames that nothing reads any more."""
    for df in frames:
        held = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if held.isDefined():
            remove(df.sparkSession, held.get())


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors and keep Arrow batches short."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_rowtide_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = os.path.join(tempfile.mkdtemp(prefix="rowtide-"), "rowtide.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, str(source.relative_to(root.parent)))
    context.addPyFile(archive)
    context._rowtide_shipped = True


def texts_of(column: pa.Array) -> list[str]:
    """The column's strings; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    Only a plain scan of fewer partitions than cores is dealt anew, hence a small input;
    a large one keeps its scan and shuffles nothing.  Plans with an exchange are left as
    they are: counting their partitions would run them.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: What this worker process has unpacked, by name.
unpacked: dict[str, object] = {}


def give_back() -> None:
    """Hand memory that this process has freed to the system; its allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def keep_only(name: str | None) -> None:
    """Drop what earlier tasks unpacked in this worker, which outlives them."""
    others = [x for x in unpacked if x != name]
    for other in others:
        del unpacked[other]
    if others:
        give_back()


def rest(spark: SparkSession) -> None:
    """Let executors give back what an earlier stage needed: a heap that grew stays as it is
    until it is collected whole, and a worker keeps what it unpacked until its next task."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(None)
        give_back()
        yield from batches

    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc")).alias("done")).mapInArrow(run, "done string").collect()


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, uses: str | None = None) -> DataFrame:
    """``step`` on each Arrow batch; ``uses`` names what it unpacks, all else is dropped."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(uses)
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if out is not None:
                    yield out

    return spread(df).mapInArrow(run, schema)


def keep_rows(df: DataFrame, mask: Callable[[pa.RecordBatch], list], uses: str | None = None) -> DataFrame:
    """Rows of ``df``, all columns as they are, for which ``mask`` holds true; ``uses`` as above."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(uses)
        for batch in batches:
            if batch.num_rows:
                kept = batch.filter(pa.array(mask(batch), pa.bool_()))
                if kept.num_rows:
                    yield kept

    return spread(df).mapInArrow(run, df.schema)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Words of 64 marks in a table of marks: at most so many rows are broadcast, some 40 MB.
MARK_WORDS = 1 << 20


def _mark(h: Column) -> tuple[Column, Column]:
    word = F.pmod(F.shiftrightunsigned(h, 6), F.lit(MARK_WORDS).cast("long"))
    return word, F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def marks(keys: DataFrame, *names: str) -> DataFrame:
    """(word, bits): a bitmap of the hashes of ``keys``, of bounded size whatever their number."""
    word, bit = _mark(F.xxhash64(*names))
    return cut(keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")))


def flagged(rows: DataFrame, found: DataFrame, h: Column, name: str) -> DataFrame:
    """``rows`` with a flag that is true wherever hash ``h`` is that of a marked key (and,
    rarely, elsewhere: what follows must not depend on it).  A null hash is never flagged."""
    word, bit = _mark(h)
    columns = rows.columns
    rows = rows.withColumns({"word": word, "bit": bit})
    hit = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    return rows.join(F.broadcast(found), "word", "left").select(*columns, hit.alias(name))


def without(docs: DataFrame, lost: DataFrame, repeated: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """``docs``, all columns as they are, without the rows listed in ``lost`` and with one
    row for each entry of ``repeated`` (both: doc_id, n_bytes, digest of the text).

    Rows travel as one struct, so no name can clash.  Only rows whose id and length are
    marked are shuffled and digested; all others pass straight through.
    """
    text = text_or_empty(text_col)
    found = marks(lost.unionByName(repeated), "doc_id", "n_bytes")
    rows = docs.select(F.col(id_col).cast(lost.schema["doc_id"].dataType).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"), F.struct(*docs.columns).alias("row"))
    rows = flagged(rows, found, F.xxhash64("doc_id", "n_bytes"), "listed")
    clear = rows.where("not listed").select("row")
    keys = ["doc_id", "n_bytes", "digest"]
    doubtful = rows.where("listed").select("doc_id", "n_bytes", digest(F.col("text")).alias("digest"), "row")

    def same(other: DataFrame) -> Column:
        return doubtful["doc_id"].eqNullSafe(other["doc_id"]) & (doubtful["n_bytes"] == other["n_bytes"]) & (doubtful["digest"] == other["digest"])

    doubtful = cut(doubtful.join(lost, same(lost), "left_anti"))
    again = doubtful.join(repeated, same(repeated), "left_semi").dropDuplicates(keys)
    kept = doubtful.join(repeated, same(repeated), "left_anti").unionByName(again).select("row")
    return clear.unionByName(kept).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_grouped(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one document of each of the ``groups`` (doc_id, n_bytes, text_hash,
    group, kept)."""
    names = ["doc_id", "n_bytes", "digest"]
    groups = cut(groups.select("doc_id", "n_bytes", F.col("text_hash").alias("digest"), "group", "kept"))
    kept = groups.where("kept")
    # Rows that repeat the kept id inside a group: the text of least hash stays.
    first = kept.groupBy(F.col("doc_id").alias("of"), F.col("group").alias("in")).agg(F.min("digest").alias("first"))
    others = kept.join(first, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("group") == F.col("in"))).where("digest <> first")
    lost = groups.where("not kept").select(*names).unionByName(others.select(*names)).distinct()
    repeated = kept.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return without(docs, cut(lost), cut(repeated), id_col, text_col, lambda text: F.xxhash64(text))
