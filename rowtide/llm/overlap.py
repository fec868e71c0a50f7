"""Near copies by exact Jaccard similarity of word shingles, no pair lost.

At a similarity of 4/5 SimHash fingerprints differ in up to a third of their bits, where
pigeonring keys are too short to join on, so pairs are found by prefix filtering: if the
shingles of every text are put in one common order, two texts of similarity ``num/den``
share a shingle among the first ``n - ceil(n * num / den) + 1`` of each.  That shingle is
the join key.  The lengths, and what is left of both texts behind their first common
shingle, bound the overlap from above; pairs that pass are confirmed on the whole sets.

The order puts frequent shingles last.  Frequencies are counted on a bounded sample of
texts: they decide how many pairs are looked at, never which are found.

Texts of equal shingle sets collapse to one node before any join.  Pairs that the caller
found otherwise (SimHash fingerprints, see ``simhash``) are checked first, and with them the
members of a key against its most common-worded member only; a key whose members then
belong to one component is settled.  Others compare what lies in different components,
in blocks of about ``block`` members a task.  There a pair is dropped where the keys just
before show that it met earlier, as all keys come in the common order, and where its folded
sketches differ too much.

A pair is first judged by sketches: a shingle turns one bit over, so two sets differ in at
least as many shingles as their sketches in bits.  Only what may still be similar has its
whole sets compared; they are made where the text lies and shuffled once, to the partner
that most pairs share.

Defined cases: words, shingles and short texts as in ``simhash``; a null text counts as
empty; texts without words are one group; a null id never becomes a component while
another id is there; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, flagged, forget, map_arrow, marks, ship, text_or_empty, texts_of
from .components import connected_components
from .shingles import SEED, shingle_hashes, simhash

#: Texts whose shingles are counted for the order, and counts that are shipped.
SAMPLE_TEXTS = 20_000
MAX_COUNTS = 200_000
#: Texts of candidate pairs that may be broadcast as keys; beyond it they are joined.
BROADCAST_KEYS = 500_000
#: Bits of the least sketch; partners that meet a shared one in a place.
SKETCH_BITS = 1024
PARTNERS = 32
#: Words of 64 bits of a folded sketch, which joins compare by themselves.
FOLD_WORDS = 8
#: Keys of a text before each of its keys that are looked at for an earlier meeting.
EARLIER = 16


def shingle_set(text: str, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words).view(np.int64))


def sketch(found: np.ndarray) -> bytes:
    """Parity of the shingles by their low bits, in half as many bits as shingles or more."""
    bits = SKETCH_BITS
    while bits * 2 < len(found):
        bits *= 2
    return np.packbits(np.bincount(found & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


def fold(held: bytes) -> np.ndarray:
    """A sketch laid together to FOLD_WORDS words: sets differ in as many shingles or more."""
    return np.bitwise_xor.reduce(np.frombuffer(held, "<i8").reshape(-1, FOLD_WORDS), axis=0)


def _folds_near(num: int, den: int) -> Column:
    """Whether the folded sketches of x and y leave room for the similarity."""
    differ = sum((F.bit_count(F.col("x.fold")[i].bitwiseXOR(F.col("y.fold")[i])) for i in range(FOLD_WORDS)), F.lit(0))
    return differ * (num + den) <= (F.col("x.size") + F.col("y.size")) * (den - num)


def apart(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Of pairs of sketches, in how many shingles their sets differ at least."""
    out = np.empty(len(left), np.int64)
    sizes = np.array([(len(x), len(y)) for x, y in zip(left, right, strict=True)]).reshape(-1, 2)
    for m, n in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes == (m, n)).all(axis=1))
        x, y = (np.frombuffer(b"".join(side[i] for i in at), np.uint8).reshape(len(at), -1) for side in (left, right))
        while x.shape[1] != y.shape[1]:  # the halves of a sketch laid together are the shorter sketch
            x, y = (z if z.shape[1] == min(x.shape[1], y.shape[1]) else z[:, : z.shape[1] // 2] ^ z[:, z.shape[1] // 2 :] for z in (x, y))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))


def frequent(docs: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, ascending, and their counts there."""
    text = text_or_empty(text_col)
    n = docs.count()
    share = int(min(1.0, SAMPLE_TEXTS / max(n, 1)) * (1 << 30))
    some = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x, words) for x in texts_of(batch.column(0))]
        found, counts = np.unique(np.concatenate(sets), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts.astype(np.int64))], ["shingle", "n"])

    counted = map_arrow(some, step, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.where("n > 3").orderBy(F.desc("n"), "shingle").limit(MAX_COUNTS).toArrow()
    known, counts = (top.column(c).to_numpy() for c in ("shingle", "n"))
    order = np.argsort(known)
    return known[order], counts[order]


def prefixes(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, text_hash, n_bytes, node, fp, size, rare, sketch, fold, prefix) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, text_col, words))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, counts = shared.value
        nodes, prints, sizes, rare, sketches, folds, heads = [], [], [], [], [], [], []
        for x in texts_of(batch.column(3)):
            hashes = shingle_hashes(x, words)
            s = np.unique(hashes.view(np.int64))
            n = len(s)
            often = np.zeros(n, np.int64)
            if len(known) and n:
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                often = np.where(known[at] == s, counts[at], 0)
            head = n - -(-n * num // den) + 1 if n else 0
            nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
            prints.append(simhash(hashes))
            sizes.append(n)
            rare.append(float((often == 0).sum() / max(n, 1)))
            sketches.append(sketch(s))
            folds.append(fold(sketches[-1]))
            heads.append(s[np.lexsort((s, often))[:head]])
        return pa.RecordBatch.from_arrays(
            [
                *batch.columns[:3], pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()),
                pa.array(rare, pa.float64()), pa.array(sketches, pa.binary()), pa.array(folds, pa.list_(pa.int64())), pa.array(heads, pa.list_(pa.int64())),
            ],
            ["doc_id", "text_hash", "n_bytes", "node", "fp", "size", "rare", "sketch", "fold", "prefix"],
        )

    return map_arrow(_rows(docs, id_col, text_col), step, "doc_id long, text_hash long, n_bytes long, node long, fp long, size int, rare double, sketch binary, fold array<long>, prefix array<long>")


def _may_reach(size: Column, at: Column, other: Column, num: int, den: int) -> Column:
    """Whether the overlap may suffice when nothing is common before place ``at``."""
    return (size - at) * (num + den) >= (size + other) * num


def possible(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Those (a, b) pairs whose sketches leave room for the similarity: none that has it is lost."""
    ends = nodes.select("node", "size", "sketch")
    left, right = (ends.select(F.col("node").alias(n), F.col("size").alias(f"size_{n}"), F.col("sketch").alias(f"sketch_{n}")) for n in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")

    def bound(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
        least = apart(batch.column(4).to_pylist(), batch.column(5).to_pylist())
        return batch.select(["a", "b"]).filter(pa.array(least * (num + den) <= total * (den - num)))

    return cut(map_arrow(both, bound, "a long, b long"))


def confirmed(pairs: DataFrame, docs: DataFrame, prints: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int) -> DataFrame:
    """Those (a, b) pairs of nodes whose whole shingle sets are similar enough."""
    pairs = cut(pairs.distinct())
    left = possible(pairs, nodes, num, den)
    forget(pairs)
    degree = cut(left.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")))
    met = left.join(degree.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").join(degree.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
    # The set of the end with more pairs goes to its partners' place, once for so many of them.
    first = F.col("n_a") >= F.col("n_b")
    met = met.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("node"), F.greatest("n_a", "n_b").alias("n"))
    met = met.select("hub", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / PARTNERS)).cast("int").alias("place"), "node")
    met = met.unionByName(met.select("hub", "place", F.col("hub").alias("node")).distinct())
    # Of rows that bear a node's set, one.
    holders = prints.join(degree, "node", "left_semi").groupBy("node").agg(F.min(F.struct("text_hash", "doc_id")).alias("of"))
    sent = cut(met.join(holders, "node").select("hub", "place", "node", "of.text_hash", "of.doc_id"))
    small = sent.count() <= BROADCAST_KEYS
    rows = _rows(docs, id_col, text_col).select("text_hash", "doc_id", "text")
    rows = flagged(rows, marks(sent, "text_hash"), F.xxhash64("text_hash"), "sent").where("sent").select("text_hash", "doc_id", "text")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(x, words) for x in texts_of(batch.column(2))]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], ["text_hash", "doc_id", "shingles"])

    made = map_arrow(rows, sets, "text_hash long, doc_id long, shingles array<long>").alias("x")
    to = (F.broadcast(sent) if small else sent).alias("y")
    routed = made.join(to, (F.col("x.text_hash") == F.col("y.text_hash")) & F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")))
    routed = routed.select("hub", "place", "node", "shingles").repartition("hub", "place").sortWithinPartitions("hub", "place", F.col("node") != F.col("hub"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            found = []
            for hub, place, node, held in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                s = held.values.to_numpy()
                if node == hub:
                    at, own = (hub, place), s
                elif at == (hub, place) and len(np.intersect1d(own, s, assume_unique=True)) * (num + den) >= (len(own) + len(s)) * num:
                    found.append((min(hub, node), max(hub, node)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    ship(docs.sparkSession)
    found = cut(routed.mapInArrow(judge, "a long, b long").distinct())
    forget(left, degree, sent)
    return found


def links(
    docs: DataFrame, prints: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int, block: int, first: Callable[[DataFrame], DataFrame] | None
) -> DataFrame:
    """(a, b) links between nodes: pairs of the similarity asked for, with the same
    components as all such pairs."""
    nodes = cut(prints.groupBy("node").agg(F.any_value(F.struct("fp", "size", "rare", "sketch", "fold", "prefix")).alias("of")).select("node", "of.*"))
    check = lambda pairs: confirmed(pairs, docs, prints, nodes, id_col, text_col, words, num, den)
    keyed = nodes.select("node", "size", "rare", F.posexplode("prefix").alias("at", "key"))
    # Most keys are held by one text only and fall out by their count alone.
    common = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = cut(flagged(keyed, marks(common, "key"), F.xxhash64("key"), "met").where("met").drop("met"))
    keys = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.min(F.struct("rare", "node", "size")).alias("mid"))
    keys = cut(keys.where("n > 1"))
    partner = F.greatest(F.col("least"), F.ceil(F.col("size") * num / den))
    shared = cut(held.join(keys, "key").where(_may_reach(F.col("size"), F.col("at"), partner, num, den)).select("key", "node", "size", "at", "mid"))
    forget(held, keys)
    alike = F.least("size", "mid.size") * den >= F.greatest("size", "mid.size") * num
    stars = shared.where((F.col("node") != F.col("mid.node")) & alike).select(F.least("node", "mid.node").alias("a"), F.greatest("node", "mid.node").alias("b"))
    if first:
        stars = first(nodes.select("node", "fp")).unionByName(stars)
    starred = check(stars)
    placed = shared.join(connected_components(starred), "node", "left").select("key", "node", "size", "at", F.coalesce("component", "node").alias("part"))
    placed = cut(placed)
    forget(shared)
    open_keys = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    open_keys = cut(open_keys.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    # Texts that share a key share many; a pair meets anew only where the keys before tell no earlier one.
    earlier = F.collect_list("key").over(Window.partitionBy("node").orderBy("at").rowsBetween(-EARLIER, -1))
    left = placed.join(open_keys, "key").withColumn("earlier", earlier).join(nodes.select("node", "fold"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Each pair of blocks meets in one place: (smaller, larger).
    met = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    left = left.select("key", "node", "size", "at", "part", "fold", "earlier", "own", met).withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})
    x, y = left.alias("x"), left.alias("y")
    sizes = F.least("x.size", "y.size") * den >= F.greatest("x.size", "y.size") * num
    rest = x.join(
        y,
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.p") == F.col("y.p"))
        & (F.col("x.q") == F.col("y.q"))
        & (F.col("x.node") < F.col("y.node"))
        & (F.col("x.part") != F.col("y.part"))
        & ((F.col("x.own") != F.col("y.own")) | (F.col("x.p") == F.col("x.q")))
        & sizes
        & _folds_near(num, den)
        & _may_reach(F.col("x.size"), F.col("x.at"), F.col("y.size"), num, den)
        & _may_reach(F.col("y.size"), F.col("y.at"), F.col("x.size"), num, den)
        & ~F.arrays_overlap("x.earlier", "y.earlier"),
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    found = starred.unionByName(check(rest))
    forget(placed, open_keys, nodes)
    return found


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    words: int = 5,
    num: int = 4,
    den: int = 5,
    block: int = 512,
    first: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per input row: doc_id, text_hash, n_bytes, group (a node that names the component),
    component_id, kept.  Texts link at a Jaccard similarity of ``num`` / ``den`` or more; ``first``
    gives pairs (a, b) of likely links from the nodes and their fingerprints (node, fp)."""
    if not 0 < num <= den:
        raise ValueError("the similarity must be above 0 and at most 1")
    prints = cut(prefixes(docs, id_col, text_col, words, num, den))
    found = links(docs, prints, id_col, text_col, words, num, den, block, first)
    classes = connected_components(found)
    placed = cut(prints.select("doc_id", "text_hash", "n_bytes", "node").join(classes, "node", "left").select("doc_id", "text_hash", "n_bytes", F.coalesce("component", "node").alias("group")))
    least = cut(placed.groupBy("group").agg(F.min("doc_id").alias("component_id")))
    return placed.join(least, "group").select("doc_id", "text_hash", "n_bytes", "group", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
