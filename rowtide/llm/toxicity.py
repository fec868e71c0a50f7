"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are the words of a whole text and their beginnings of ``STEM`` letters; every term
that an example holds is indexed, however rare or frequent.  A term weighs (1 + ln count)
x idf x relevance; relevance is 1 plus the square root of the term's G statistic against
the label among the examples, so that a neighbour is near for what tells the labels apart
and not for its topic alone (without it held-out recall is about a half, see README).

The labelled examples lie in an inverted index cut into blocks of like examples.  Short
postings lists are summed whole.  Of a long list only the largest weight in each block is
read at first: with the short part it bounds every cosine in the block from above.  Blocks
whose bound reaches the k-th best cosine found so far are then scored in full, hence what
is returned is exact.  Votes weighted by distance give a raw score, and a monotone map
fitted by leaving each example out turns it into a probability.  The neighbours are the
evidence.

Fitting uses at most ``max_examples`` labelled rows, those of least hash, and of these the
first whose texts together hold ``max_bytes`` at most (documented bounds, so the model that
is broadcast is bounded too; a text that no longer fits is passed over).  One task fits them;
the driver sees the finished model as bytes only.  Rows of equal text and label are one
example.  Scoring reads every row and whole texts of any length.

Defined cases: a null or empty text, or one that shares no term with an example, gets the
rate of toxic rows among the examples (among those without terms, if there are any); ties
between neighbours go to the smaller example id; labels that are null are no examples; a
document labelled several times gives one example for each distinct label row; repeated
rows are scored one by one; without any example every score is 0; an empty table gives an
empty result; extra columns, whatever their names, are not used and ``keep_clean`` hands
them on.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keep_only, keep_rows, map_arrow, ship, text_or_empty, texts_of, unpacked

MAX_EXAMPLES = 3_000
MAX_BYTES = 64 << 20
NEIGHBOURS = 16
STEM = 5
BLOCK = 32
#: A term that more than this share of the examples holds has a long list.
LONG_SHARE = 1 / 8
#: Words whose terms are remembered in a worker; the memory then starts afresh.
REMEMBERED = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> Counter:
    """Counts of the words and word beginnings of a whole text."""
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall(text.lower())).items():
        out[w] += n
        if len(w) > STEM:
            out[w[:STEM] + "*"] += n
    return out


class BlockMaxIndex:
    """Exact top-k cosine over weighted term vectors of unit length.

    ``vectors`` are pairs of ascending term numbers and weights; rows keep their place
    in that list as their name, whatever block they lie in.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK, long_share: float = LONG_SHARE):
        self.n, self.block = len(vectors), block
        sizes = np.array([len(t) for t, _ in vectors], np.int64)
        term = np.concatenate([t for t, _ in vectors] or [np.empty(0, np.int32)])
        weight = np.concatenate([w for _, w in vectors] or [np.empty(0)]).astype(np.float64)
        row = np.repeat(np.arange(self.n), sizes)
        length = np.bincount(term, minlength=n_terms)
        self.long = np.full(n_terms, -1, np.int64)
        often = np.flatnonzero(length > max(block // 4, self.n * long_share))
        self.long[often] = np.arange(len(often))
        # Like examples share a block: ordered by their two heaviest frequent terms.
        is_long = self.long[term] >= 0
        dense = np.zeros((self.n, len(often)))
        dense[row[is_long], self.long[term[is_long]]] = weight[is_long]
        if len(often) > 1 and self.n:
            top = np.argsort(-dense, axis=1, kind="stable")[:, :2]
            self.rows = np.lexsort((np.arange(self.n), top[:, 1], top[:, 0]))
        else:
            self.rows = np.arange(self.n)
        self.n_blocks = -(-self.n // block)
        full = np.zeros((self.n_blocks * block, len(often)))
        full[: self.n] = dense[self.rows]
        # Long lists by block, term and place in the block; and the largest weight in each block.
        self.dense = np.ascontiguousarray(full.reshape(self.n_blocks, block, len(often)).transpose(0, 2, 1))
        self.top = np.ascontiguousarray(self.dense.max(axis=2).T)
        place = np.empty(self.n, np.int64)
        place[self.rows] = np.arange(self.n)
        order = np.lexsort((place[row[~is_long]], term[~is_long]))
        self.places = place[row[~is_long]][order].astype(np.int32)
        self.weights = weight[~is_long][order]
        first = np.searchsorted(term[~is_long][order], np.arange(n_terms + 1))
        self.first, self.size = first[:-1].copy(), np.diff(first)

    def nearest(self, query: tuple[np.ndarray, np.ndarray], k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k largest positive cosines as (cosine, row), ties to the smaller row."""
        term, weight = query
        if not len(term) or not self.n:
            return []
        long = self.long[term]
        short = long < 0
        score = np.zeros(self.n_blocks * self.block)
        if short.any():
            start, size = self.first[term[short]], self.size[term[short]]
            # The places of all postings of these lists, one list behind the other.
            at = (start - np.cumsum(size) + size).repeat(size)
            at += np.arange(len(at))
            part = self.weights.take(at)
            part *= weight[short].repeat(size)
            score = np.bincount(self.places.take(at), part, minlength=len(score))
        score = score.reshape(self.n_blocks, self.block)
        long, held = long[~short], weight[~short]
        bound = score.max(axis=1) + held @ self.top[long]
        order = np.argsort(-bound, kind="stable")
        found, rows, least, at = np.empty(0), np.empty(0, np.int64), 0.0, 0
        step = -(-k // self.block) + self.n_blocks // 12 + 1
        while at < self.n_blocks:
            some = order[at : at + step]
            some = some[bound[some] >= max(least - 1e-12, 1e-300)]
            if not len(some):
                break
            got = (score[some] + held @ self.dense[some[:, None], long]).ravel()
            own = (some[:, None] * self.block + np.arange(self.block)).ravel()
            hit = np.flatnonzero((got > 0) & (got >= least - 1e-12) & (own < self.n))
            found, rows = np.concatenate((found, got[hit])), np.concatenate((rows, self.rows[own[hit]]))
            if skip >= 0:
                left = rows != skip
                found, rows = found[left], rows[left]
            if len(found) > k:
                best = np.lexsort((rows, -found))[:k]
                found, rows = found[best], rows[best]
            if len(found) == k:
                least = float(found.min())
            at += step
            step = self.n_blocks
        best = np.lexsort((rows, -found))[:k]
        return list(zip(found[best].tolist(), rows[best].tolist(), strict=True))


class _Known(dict):
    """Word to the numbers of its terms, -1 for none, worked out when first asked for."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, int]:
        of = self.vocabulary.get
        self[word] = found = (of(word, -1), of(word[:STEM] + "*", -1) if len(word) > STEM else -1)
        return found

    def __reduce__(self):
        return _Known, (self.vocabulary,)


@dataclass
class Model:
    vocabulary: dict[str, int]
    weight: np.ndarray
    ids: list[int]
    labels: np.ndarray
    index: BlockMaxIndex | None
    bare: float
    prior: float
    knots: np.ndarray
    values: np.ndarray
    neighbours: int = NEIGHBOURS
    known: dict[str, tuple[int, int]] = field(init=False, repr=False)

    def __post_init__(self):
        self.known = _Known(self.vocabulary)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ascending term numbers and weights of unit length; terms of no example weigh nothing."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        words = Counter(_WORD.findall(text.lower()))
        held = np.fromiter(chain.from_iterable(map(self.known.__getitem__, words)), np.int64, 2 * len(words))
        times = np.fromiter(words.values(), np.float64, len(words)).repeat(2)
        there = held >= 0
        return weigh(held[there], times[there], self.weight)

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Distance-weighted share of toxic neighbours, drawn a little to the prior."""
        weight = [1 / (1.02 - min(c, 1.0)) for c, _ in near]
        toxic = sum(w for w, (_, i) in zip(weight, near, strict=True) if self.labels[i])
        return (toxic + self.prior) / (sum(weight) + 1)

    def score(self, text: str) -> tuple[float, list[tuple[float, int]]]:
        near = self.index.nearest(self.vector(text), self.neighbours) if self.index is not None else []
        if not near:
            return self.bare, []
        return float(np.interp(self.vote(near), self.knots, self.values)), near


def weigh(held: np.ndarray, times: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights of unit length) from term numbers with counts, repeats allowed."""
    if not len(held):
        return held, times
    term, at = np.unique(held, return_inverse=True)
    raw = (1 + np.log(np.bincount(at, times))) * weight[term]
    return term, raw / math.sqrt(float(raw @ raw))


def _monotone(raw: np.ndarray, labels: np.ndarray, least: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins of raw scores, smoothed by one row of each label."""
    if not len(raw):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for at in range(0, len(order), least):
        part = order[at : at + least]
        pools.append([float(labels[part].sum()), float(len(part)), float(raw[part].sum())])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools])


def learning_rows(id_col: str = "doc_id") -> Column:
    """True for rows that may be learned from: crc32 of the id as text, mod 5, not 0."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(5)) != 0


def term_weights(rows: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """idf x relevance of terms that ``rows`` of ``n`` examples hold, ``toxic`` of them toxic."""
    idf = np.log((n + 2) / (rows + 1))
    prior = n_toxic / n
    if not 0 < prior < 1:
        return idf
    share = toxic / rows
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(share > 0, share * np.log(share / prior), 0.0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - prior)), 0.0)
    return idf * (1 + np.sqrt(np.maximum(2 * rows * gain, 0)))


def fit_examples(examples: list[tuple[int, str, bool]], neighbours: int = NEIGHBOURS) -> Model:
    """A model of (id, text, toxic) examples, which are few enough for one process."""
    empty = np.array([0.0, 1.0])
    examples = sorted(examples)
    n, n_toxic = len(examples), sum(y for _, _, y in examples)
    if not n:
        return Model({}, np.empty(0), [], np.empty(0, bool), None, 0.0, 0.0, empty, empty, neighbours)
    vocabulary: dict[str, int] = {}
    # Flat arrays: they are given back to the system as soon as they are done with.
    held, times, sizes = array("i"), array("f"), []
    for _, text, _ in examples:
        found = terms(text)
        held.extend([vocabulary.setdefault(t, len(vocabulary)) for t in found])
        times.extend(found.values())
        sizes.append(len(found))
    labels = np.array([y for _, _, y in examples], bool)
    ids = [i for i, _, _ in examples]
    examples.clear()
    term, size = np.frombuffer(held, np.int32), np.array(sizes)
    rows = np.bincount(term, minlength=len(vocabulary)).astype(float)
    toxic = np.bincount(term, np.repeat(labels, size), minlength=len(vocabulary))
    weight = term_weights(rows, toxic, n, n_toxic) if len(vocabulary) else np.empty(0)
    row = np.repeat(np.arange(n, dtype=np.int32), size)
    order = np.lexsort((term, row))
    term = term[order]
    raw = (1 + np.log(np.frombuffer(times, np.float32)[order].astype(np.float64))) * weight[term]
    raw /= np.sqrt(np.bincount(row, raw * raw, minlength=n))[row]
    stops = np.cumsum(size)
    some = np.flatnonzero(size)
    prior = n_toxic / n
    bare = labels[size == 0].tolist()
    vectors = [(term[b - k : b], raw[b - k : b]) for b, k in zip(stops[some].tolist(), size[some].tolist(), strict=True)]
    index = BlockMaxIndex(vectors, len(vocabulary)) if len(some) else None
    model = Model(
        vocabulary, weight, [ids[i] for i in some.tolist()], labels[some], index, (sum(bare) + prior) / (len(bare) + 1), prior, empty, empty, neighbours
    )
    if index is not None:
        left_out = [(model.vote(near), model.labels[i]) for i, v in enumerate(vectors) if (near := index.nearest(v, neighbours, skip=i))]
        model.knots, model.values = _monotone(np.array([a for a, _ in left_out]), np.array([b for _, b in left_out], float))
    return model


@dataclass(frozen=True)
class Fitted:
    """A model as it travels; a worker unpacks it once."""

    payload: bytes
    name: str

    def model(self) -> Model:
        if self.name not in unpacked:
            keep_only(None)
            unpacked[self.name] = pickle.loads(zlib.decompress(self.payload))
        return unpacked[self.name]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    max_examples: int = MAX_EXAMPLES,
    max_bytes: int = MAX_BYTES,
    neighbours: int = NEIGHBOURS,
) -> Fitted:
    """``labels``: (doc_id, toxic), the rows that may be learned from."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).alias("toxic")).distinct()
    n_usable = usable.count()
    share = int(min(1.0, 1.3 * max_examples / max(n_usable, 1)) * (1 << 30))
    likely = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    # At most max_examples rows of nine bytes.
    chosen = cut(likely.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_examples))
    text = text_or_empty(text_col)
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(chosen), "doc_id")
    held = held.select("doc_id", "toxic", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("digest"), "text")
    # Names and sizes first; then the texts that fit, each once.
    named = held.groupBy("digest", "toxic").agg(F.min("doc_id").alias("doc_id"), F.any_value("size").alias("size"))
    room, taken = max_bytes, []
    for r in named.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "digest").limit(max_examples).collect():
        if r["size"] <= room:
            room -= r["size"]
            taken.append((r["doc_id"], r["toxic"], r["digest"]))
    wanted = docs.sparkSession.createDataFrame(taken, "doc_id long, toxic boolean, digest string")
    texts = held.join(F.broadcast(wanted), ["doc_id", "toxic", "digest"], "left_semi").dropDuplicates(["doc_id", "toxic", "digest"])
    spark = docs.sparkSession
    ship(spark)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples: list[tuple[int, str, bool]] = []
        for batch in batches:
            examples.extend(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(fit_examples(examples, neighbours)))], pa.binary())], ["model"])

    # At most max_examples rows and max_bytes go into that one task.
    row = texts.select("doc_id", "text", "toxic").repartition(1).mapInArrow(learn, "model binary").first()
    payload = bytes(row["model"]) if row else zlib.compress(pickle.dumps(fit_examples([], neighbours)))
    return Fitted(payload, hashlib.sha256(payload).hexdigest())


def score_documents(docs: DataFrame, model: Fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted, evidence (the nearest examples)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value.model()
        scores, evidence = [], []
        for x in texts_of(batch.column(1)):
            s, near = m.score(x)
            scores.append(s)
            evidence.append([{"example": m.ids[i], "toxic": int(m.labels[i]), "cosine": c} for c, i in near[:3]])
        kind = pa.list_(pa.struct([("example", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, kind)],
            ["doc_id", "score", "predicted", "evidence"],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, step, "doc_id long, score double, predicted int, evidence array<struct<example:long,toxic:int,cosine:double>>", model.name)


def keep_clean(docs: DataFrame, model: Fitted, text_col: str = "text", *, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def clean(batch: pa.RecordBatch) -> list[bool]:
        m = shared.value.model()
        return [m.score(x)[0] < threshold for x in texts_of(batch.column(at))]

    return keep_rows(docs, clean, model.name)
