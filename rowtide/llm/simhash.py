"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is 64 bits over hashed word shingles.  Its ``segments`` equal parts
form a ring.  If two fingerprints differ in at most ``distance`` bits, then some
start on the ring has every chain of 1, 2, ... consecutive segments differing in at
most (chain length) * distance / segments bits.  Chains whose budget is below one
bit must be equal: those bits are the join key.  A joined pair must then hold the
budgets of all longer chains, and at last the full Hamming distance.

Rows of one fingerprint collapse to one node before any join.  A key shared by more
than ``bucket`` fingerprints is not joined pair by pair: for a distance of two its members
meet at the points one bit away from them (two fingerprints differ in at most two bits
exactly if such points coincide), which is linear in the members and loses no component.
For other distances they are compared in pairs of blocks of about ``bucket`` members.

Defined cases: null text counts as empty; a text without words has fingerprint zero
and links like any other; rows of equal fingerprint are one group whatever their
ids; a null id never becomes a component while another id is there; an empty table
gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import overlap
from .common import cut, drop_grouped, map_arrow, text_or_empty, texts_of
from .components import connected_components
from .shingles import shingle_hashes, simhash

#: Widest distance whose join keys have 16 bits or more (``similar_pairs``).
WIDEST = 3


def fingerprint(text: str, words: int = 3) -> int:
    """Signed 64-bit SimHash: a bit is set if it is set in over half the shingles."""
    return simhash(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp, text_hash, n_bytes): whole texts, one pass, nothing shuffled.

    ``text_hash`` and ``n_bytes`` tell rows apart that repeat an id over different texts.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [fingerprint(x, words) for x in texts_of(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), batch.column(2), batch.column(3)], ["doc_id", "fp", "text_hash", "n_bytes"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), F.octet_length(text).cast("long").alias("n_bytes"))
    return map_arrow(rows, step, "doc_id long, fp long, text_hash long, n_bytes long")


def _turned(x: Column, start: Column, width: int) -> Column:
    """``x`` rotated so that segment ``start`` comes lowest."""
    by = (start * width).cast("int")
    right = F.call_function("shiftrightunsigned", x, by)
    left = F.call_function("shiftleft", x, (F.lit(64) - by).cast("int"))
    return F.when(by == 0, x).otherwise(right.bitwiseOR(left))


def _mask(bits: int) -> Column:
    return F.lit(-1 if bits >= 64 else (1 << bits) - 1).cast("long")


def _chain_holds(differ: Column, start: Column, segments: int, distance: int) -> Column:
    width = 64 // segments
    ring = _turned(differ, start, width)
    holds = F.lit(True)
    for length in range(1, segments + 1):
        holds = holds & (F.bit_count(ring.bitwiseAND(_mask(length * width))) <= length * distance // segments)
    return holds


def _equal(segments: int, distance: int) -> int:
    """Longest chain whose budget is below one bit."""
    return max(n for n in range(1, segments + 1) if n * distance // segments == 0)


def fingerprint_links(
    prints: DataFrame, *, distance: int = 2, segments: int | None = None, bucket: int = 256
) -> DataFrame:
    """(a, b) links between distinct ``fp`` values: every pair within ``distance``, but of
    hot buckets at a distance of two a spanning set.

    More segments make longer keys and more copies of each row.  Unless given, their
    number is the least that leaves about ``bucket`` / 16 fingerprints to a key; the links
    are the same for any number.
    """
    if segments is None:
        n = prints.count()
        segments = next((m for m in (8, 16) if n >> (64 // m * _equal(m, distance)) <= bucket // 16), 32)
    if 64 % segments or segments <= distance:
        raise ValueError("segments must divide 64 and be more than the distance")
    width = 64 // segments
    exact = _equal(segments, distance)
    if exact * width >= 64:
        raise ValueError("a distance of zero needs no links")
    starts = F.explode(F.array(*[F.lit(s) for s in range(segments)])).alias("start")
    keyed = prints.select("fp", starts)
    keyed = keyed.select("fp", "start", _turned(F.col("fp"), F.col("start"), width).bitwiseAND(_mask(exact * width)).alias("key"))
    sizes = keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = cut(sizes.where(F.col("n") > bucket))
    some_hot = bool(hot.take(1))
    calm = keyed.join(hot.select("start", "key"), ["start", "key"], "left_anti") if some_hot else keyed
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    near = (F.col("x.fp") < F.col("y.fp")) & _chain_holds(differ, F.col("x.start"), segments, distance) & (F.bit_count(differ) <= distance)
    same = (F.col("x.start") == F.col("y.start")) & (F.col("x.key") == F.col("y.key"))
    ends = F.col("x.fp").alias("a"), F.col("y.fp").alias("b")
    found = calm.alias("x").join(calm.alias("y"), same & near).select(*ends)
    if some_hot and distance == 2:
        members = keyed.join(hot.select("start", "key"), ["start", "key"], "left_semi").select("fp").distinct()
        flips = F.explode(F.array(*[F.lit(v).cast("long") for v in [0, *(1 << b for b in range(63)), -(1 << 63)]]))
        points = members.select("fp", flips.alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
        least = cut(points.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"))
        met = points.join(least, "point").where("fp <> a").select("a", F.col("fp").alias("b"))
        found = found.unionByName(met)
    elif some_hot:
        blocks = F.ceil(F.col("n") / bucket).cast("int")
        members = keyed.join(hot, ["start", "key"]).withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("fp"), blocks).cast("int")})
        # Each pair of blocks meets in one place: (smaller, larger).
        members = members.select("fp", "start", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        members = members.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})
        once = (F.col("x.p") == F.col("y.p")) & (F.col("x.q") == F.col("y.q")) & ((F.col("x.own") != F.col("y.own")) | (F.col("x.p") == F.col("x.q")))
        found = found.unionByName(members.alias("x").join(members.alias("y"), same & once & near).select(*ends))
    return found.distinct()


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    words: int = 3,
    distance: int = 2,
    segments: int | None = None,
    bucket: int = 256,
) -> DataFrame:
    """One row per input row: doc_id, fp, text_hash, n_bytes, fingerprint (hex), group (a
    fingerprint that names the component), component_id, kept."""
    prints = cut(fingerprints(docs, id_col, text_col, words))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    links = fingerprint_links(nodes.select("fp"), distance=distance, segments=segments, bucket=bucket)
    classes = connected_components(links).select(F.col("node").alias("fp"), "component")
    placed = cut(nodes.join(classes, "fp", "left").select("fp", "node", F.coalesce("component", "fp").alias("component")))
    # Written apart, so that Spark may split a component that holds most nodes.
    least = cut(placed.groupBy("component").agg(F.min("node").alias("component_id")))
    named = placed.join(least, "component").select("fp", F.col("component").alias("group"), "component_id")
    return (
        prints.join(named, "fp")
        .select(
            "doc_id",
            "fp",
            "text_hash",
            "n_bytes",
            F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
            "group",
            "component_id",
            F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        )
    )


def similar_pairs(prints: DataFrame, distance: int = WIDEST) -> DataFrame:
    """(a, b) pairs of nodes (node, fp) whose fingerprints are equal or linked: of the nodes
    of one fingerprint each with the least, of linked fingerprints the least of both."""
    least = cut(prints.groupBy("fp").agg(F.min("node").alias("a")))
    equal = prints.join(least, "fp").where("node <> a").select("a", F.col("node").alias("b"))
    linked = fingerprint_links(least.select("fp"), distance=distance).select(F.col("a").alias("fp"), F.col("b").alias("other"))
    linked = linked.join(least, "fp").select("a", F.col("other").alias("fp")).join(least.withColumnRenamed("a", "b"), "fp")
    return equal.unionByName(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: tuple[int, int] | None = None, **options) -> DataFrame:
    """``docs`` with one document of each group, all columns as they are.

    With a ``similarity`` (numerator, denominator) texts link by the Jaccard similarity of
    their shingle sets: fingerprints within ``WIDEST`` bits are joined and checked first,
    pairs of the similarity whose fingerprints differ in more are found by ``overlap``.
    """
    if similarity:
        num, den = similarity
        groups = overlap.near_groups(docs, id_col, text_col, num=num, den=den, first=similar_pairs, **options)
    else:
        groups = near_groups(docs, id_col, text_col, **options)
    return drop_grouped(docs, groups, id_col, text_col)
