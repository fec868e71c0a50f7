"""Exact duplicates by progressive refinement: length, then a hash of the first bytes,
then a hash of the whole text.

Each stage judges only what the one before left: lengths of all rows are counted, prefixes
are hashed of rows whose length occurs again, whole texts of rows whose length and prefix
hash occur again.  Between stages travel bitmaps of the keys left, whose size is bounded
whatever their number; a mark set by another key only means that a row is hashed in vain,
never another result.  Texts are never shuffled, only an id with a few bytes, and groups are
aggregated before the shuffle, so a group that holds a third of all rows costs one row per
task.  The join that brings a group's result back to its rows is a plain equi-join whose hot
partitions Spark splits at run time.

Defined cases: a null text equals the empty text; texts of any length are hashed whole; of
equal texts the row with the largest id stays (null is the smallest id); rows that repeat an
id and a text are all marked kept here, and ``drop_duplicates`` leaves one of them; an empty
table gives an empty result; columns other than id and text, whatever their names, are not
looked at, and ``drop_duplicates`` hands them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, flagged, marks, text_or_empty, without

#: Bytes that the second stage hashes.
PREFIX_BYTES = 64


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def refined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, prefix_hash, full_hash, alive.

    ``prefix_hash`` is null where the length stands alone, ``full_hash`` where length and
    prefix hash do (unless ``digest_all`` asks for it on every row).
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    count = F.count(F.lit(1)).alias("n")
    lengths = marks(rows.groupBy("n_bytes").agg(count).where("n > 1"), "n_bytes")
    rows = flagged(rows, lengths, F.xxhash64("n_bytes"), "met")
    prefix = F.xxhash64(F.substring(F.encode("text", "UTF-8"), 1, PREFIX_BYTES))
    rows = rows.select("doc_id", "n_bytes", "text", F.when(F.col("met"), prefix).alias("prefix_hash"))
    pairs = rows.where("prefix_hash is not null").groupBy("n_bytes", "prefix_hash").agg(count).where("n > 1")
    left = marks(pairs, "n_bytes", "prefix_hash")
    rows = flagged(rows, left, F.when(F.col("prefix_hash").isNotNull(), F.xxhash64("n_bytes", "prefix_hash")), "alive")
    digest = _digest(F.col("text"))
    return rows.select("doc_id", "n_bytes", "prefix_hash", (digest if digest_all else F.when(F.col("alive"), digest)).alias("full_hash"), "alive")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, n_bytes, full_hash.

    ``full_hash`` (SHA-256 of the UTF-8 bytes) is null where a row has no copy, unless
    ``digest_all`` asks for it on every row.
    """
    hashed = cut(refined(docs, id_col, text_col, digest_all=digest_all).drop("prefix_hash"))
    alive = hashed.where("alive").drop("alive")
    # Written apart, so that both sides of the join below are plain exchanges, whose hot
    # partitions Spark can split; an aggregate feeding the join would forbid that.
    groups = cut(
        alive.groupBy("n_bytes", "full_hash")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    alone = F.col("group_size").isNull()
    copies = alive.join(groups, ["n_bytes", "full_hash"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "n_bytes",
        (F.col("full_hash") if digest_all else F.when(~alone, F.col("full_hash"))).alias("full_hash"),
    )
    single = hashed.where("not alive").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "n_bytes", "full_hash"
    )
    return copies.unionByName(single).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies, all columns as they are; repeated rows leave one."""
    groups = cut(exact_groups(docs, id_col, text_col).where("group_size > 1").select("doc_id", "n_bytes", F.col("full_hash").alias("digest"), "kept"))
    lost = groups.where("not kept").drop("kept").distinct()
    repeated = groups.where("kept").groupBy("doc_id", "n_bytes", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return without(docs, lost, repeated, id_col, text_col, _digest)
