"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote low, good or nothing on a whole text.
Expectation-maximisation over the table of vote patterns (all documents counted; at
most 3 to the number of labellers patterns) estimates how each labeller votes on
either class, and from that the posterior of every pattern.  A linear scorer over
hashed words, word shapes and text statistics is then trained on posterior labels of
at most ``sample`` rows (those of least hash, and as many of them as hold ``MAX_FEATURES``
features together), so that it also judges texts on which every labeller is silent.  The
scorer decides; a text is measured once for its votes and features.

Defined cases: a null or empty text gets no votes and is scored by the scorer's bias and
the features of an empty text; texts of any length are measured whole (the share of
distinct words is the mean over stretches of ``STRETCH`` words); ties in the sample go by
hash, then id; repeated rows are scored alike; an empty table gives an empty result; extra
columns, whatever their names, are not looked at, and ``keep_good`` hands them on.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, keep_rows, map_arrow, text_or_empty, texts_of

LOW, SILENT, GOOD = 0, 1, 2
SAMPLE = 12_000
BUCKETS = 1 << 14
#: Features that may reach the driver: 12 bytes each, 72 MB.
MAX_FEATURES = 6_000_000
#: Words over which the share of distinct words is taken.
STRETCH = 4_000
_SYMBOLS = "#$%&*@^~=<>{}[]\\_|"


@dataclass(frozen=True)
class Facts:
    """What the labellers look at, measured once for each text."""

    n_words: int
    shouted: float
    stuttered: float
    symbols: float
    bars: float
    exclaimed: float
    distinct: float
    ended: float
    repeated_lines: float
    word_length: float


def facts(text: str, words: list[str]) -> Facts:
    n = len(words)
    lines = [x for x in text.split("\n") if x]
    per = 1 / max(n, 1)
    return Facts(
        n,
        sum(map(str.isupper, words)) * per,
        sum(map(operator.eq, words, words[1:])) * per,
        sum(map(text.count, _SYMBOLS)) * per,
        text.count("|") * per,
        text.count("!") * per,
        sum(len(set(words[at : at + STRETCH])) for at in range(0, n, STRETCH)) * per,
        (text.count(". ") + text.count(".\n") + text.endswith(".")) * per,
        1 - len(set(lines)) / max(len(lines), 1),
        len(text) * per,
    )


def _between(value: float, good_below: float, low_above: float) -> int:
    return LOW if value > low_above else GOOD if value < good_below else SILENT


#: Name and vote of each labeller; none votes on texts too short for it.
LABELLERS: dict[str, Callable[[Facts], int]] = {
    "shouting": lambda f: _between(f.shouted, 0.15, 0.4) if f.n_words >= 5 else SILENT,
    "stutter": lambda f: _between(f.stuttered, 0.03, 0.15) if f.n_words >= 12 else SILENT,
    "symbols": lambda f: _between(f.symbols, 0.05, 0.3) if f.n_words >= 5 else SILENT,
    "bars": lambda f: _between(f.bars, 0.02, 0.15) if f.n_words >= 5 else SILENT,
    "exclaiming": lambda f: _between(f.exclaimed, 0.05, 0.3) if f.n_words >= 5 else SILENT,
    "diversity": lambda f: _between(1 - f.distinct, 0.5, 0.9) if f.n_words >= 40 else SILENT,
    "sentences": lambda f: SILENT if f.n_words < 30 else GOOD if 0.02 < f.ended < 0.4 else LOW if f.ended < 0.004 else SILENT,
    "lines": lambda f: SILENT if f.n_words < 30 else _between(f.repeated_lines, 0.1, 0.5),
    "word_length": lambda f: SILENT if f.n_words < 10 else GOOD if 3 < f.word_length < 12 else LOW if f.word_length > 25 else SILENT,
}


def votes(f: Facts) -> int:
    """All votes as one number, a base-three digit for each labeller."""
    code = 0
    for judge in LABELLERS.values():
        code = code * 3 + judge(f)
    return code


def digits(code: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        code, d = divmod(code, 3)
        out.append(d)
    return out[::-1]


@dataclass
class LabelModel:
    """Shares of the kinds of text and P(vote | kind) as [kind, labeller, vote].

    Kind 0 is good text, the others are kinds of low text: labellers specialise, so
    within the low class their votes are far from independent.
    """

    shares: np.ndarray
    table: np.ndarray

    def accuracies(self) -> dict[str, float]:
        """Share of right votes among the votes cast."""
        cast = np.einsum("k,kjv->j", self.shares, self.table[:, :, [LOW, GOOD]])
        right = self.shares[0] * self.table[0, :, GOOD] + self.shares[1:] @ self.table[1:, :, LOW]
        return dict(zip(LABELLERS, (right / np.maximum(cast, 1e-12)).tolist(), strict=True))

    def log_odds(self, code: int) -> float:
        v = digits(code)
        like = np.log(self.shares) + np.log(self.table[:, np.arange(len(v)), v]).sum(1)
        top = like[1:].max()
        return float(like[0] - top - math.log(np.exp(like[1:] - top).sum()))


#: Weight of the assumptions against the data: pseudo-rows as a share of all rows.
ASSUMED = 0.2


def estimate(patterns: dict[int, int], rounds: int = 50) -> LabelModel:
    """Expectation-maximisation from {vote code: rows}.

    Silence tells nothing: a labeller is silent for reasons of length, which are the
    same in either class.  The start assumes what a labeller is for: each kind of low
    text is one that a labeller finds nine times in ten while others speak up one time
    in ten, and on good text a labeller is wrong one time in a hundred.  The last
    assumption stays in force as pseudo-rows.
    """
    k = len(LABELLERS)
    codes = sorted(patterns)
    counts = np.array([patterns[c] for c in codes], float)
    v = np.array([digits(c) for c in codes]).reshape(-1, k)
    table = np.ones((k + 1, k, 3))
    table[0, :, LOW] = 0.01
    table[1:, :, LOW] = 0.1 + 0.8 * np.eye(k)
    table[:, :, GOOD] = 1 - table[:, :, LOW]
    shares = np.array([0.85] + [0.15 / k] * k)
    start, j, total = table.copy(), np.arange(k), counts.sum()
    for _ in range(rounds if len(codes) else 0):
        like = np.log(shares)[:, None] + np.log(table[:, j, v]).sum(2)
        held = np.exp(like - like.max(0))
        weight = held / held.sum(0) * counts
        shares = (weight.sum(1) + 1) / (total + k + 1)
        for c in range(k + 1):
            pseudo = 2 + ASSUMED * (total if c == 0 else weight[c].sum())
            low = (weight[c][:, None] * (v == LOW)).sum(0) + pseudo * start[c, :, LOW]
            fine = (weight[c][:, None] * (v == GOOD)).sum(0) + pseudo * start[c, :, GOOD]
            table[c, :, LOW], table[c, :, GOOD] = low / (low + fine), fine / (low + fine)
    return LabelModel(shares, table)


def _shape(word: str) -> str:
    head = "U" if word.isupper() else "T" if word[:1].isupper() else "l" if word.islower() else "d" if word.isdigit() else "x"
    tail = word[-1:]
    return head + ("" if tail.isalnum() else tail) + str(min(len(word), 20) // 4)


def features(words: list[str], f: Facts, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets and values (unit length) of a whole text."""
    counts: Counter = Counter()
    for w, n in Counter(words).items():
        counts["w" + w.lower().strip(".,;:!?")] += n
        counts["s" + _shape(w)] += 4 * n
    for name in ("shouted", "stuttered", "symbols", "bars", "exclaimed", "distinct", "ended", "repeated_lines"):
        counts[f"f{name}{min(int(getattr(f, name) * 10), 10)}"] += 3 * max(f.n_words, 1)
    held: dict[int, float] = {}
    for t, n in counts.items():
        h = zlib.crc32(t.encode("utf-8"))
        at = h % buckets
        held[at] = held.get(at, 0.0) + (1 if h & (1 << 30) else -1) * math.sqrt(n)
    at = np.array(list(held), np.int64)
    value = np.array(list(held.values()))
    norm = np.sqrt((value**2).sum())
    return at, value / norm if norm else value


def measure(text: str, buckets: int = BUCKETS) -> tuple[int, np.ndarray, np.ndarray]:
    """(vote code, buckets, values) of a whole text."""
    words = text.split()
    f = facts(text, words)
    return votes(f), *features(words, f, buckets)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def log_odds(self, at: np.ndarray, value: np.ndarray) -> float:
        return float(self.weights[at] @ value + self.bias)


def slope(weights: np.ndarray, bias: float, at: np.ndarray, value: np.ndarray, target: float) -> float:
    """Derivative of the cross-entropy of a row by its log-odds."""
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(weights[at] @ value) + bias)))) - target


def train(rows: list[tuple[np.ndarray, np.ndarray]], posteriors: np.ndarray, buckets: int = BUCKETS, rounds: int = 12, rate: float = 0.5, decay: float = 1e-5) -> Scorer:
    """Logistic regression by adaptive gradient steps on soft labels."""
    weights, bias = np.zeros(buckets), 0.0
    grown, grown_bias = np.full(buckets, 1e-6), 1e-6
    order = np.random.default_rng(5)
    for _ in range(rounds):
        for i in order.permutation(len(rows)).tolist():
            at, value = rows[i]
            off = slope(weights, bias, at, value, posteriors[i])
            step = off * value + decay * weights[at]
            grown[at] += step**2
            weights[at] -= rate * step / np.sqrt(grown[at])
            grown_bias += off**2
            bias -= rate * off / math.sqrt(grown_bias)
    return Scorer(weights, bias)


@dataclass
class QualityModel:
    labels: LabelModel
    scorer: Scorer

    def judge(self, text: str) -> tuple[int, float, float]:
        """(vote code, posterior by the labellers, score by the scorer)."""
        code, at, value = measure(text, len(self.scorer.weights))
        a = max(-12.0, min(12.0, self.labels.log_odds(code)))
        b = max(-12.0, min(12.0, self.scorer.log_odds(at, value)))
        return code, 1 / (1 + math.exp(-a)), 1 / (1 + math.exp(-b))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sample: int = SAMPLE, buckets: int = BUCKETS) -> QualityModel:
    """Votes are counted over all of ``docs``; the scorer learns from ``sample`` rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = [votes(facts(x, x.split())) for x in texts_of(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64())], ["doc_id", "code"])

    # At most 3 to the number of labellers rows reach the driver, one for each pattern.
    voted = map_arrow(rows, vote, "doc_id long, code long")
    patterns = {r["code"]: r["n"] for r in voted.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = estimate(patterns)
    n = sum(patterns.values())
    share = int(min(1.0, 1.3 * sample / max(n, 1)) * (1 << 30))
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [measure(x, buckets) for x in texts_of(batch.column(1))]
        at, value = pa.array([a for _, a, _ in out], pa.list_(pa.int64())), pa.array([v.astype(np.float32) for _, _, v in out], pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _, _ in out], pa.int64()), at, value], ["doc_id", "code", "at", "value"])

    described = map_arrow(rows.where(pick), describe, "doc_id long, code long, at array<long>, value array<float>")
    described = cut(described.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "code").limit(sample))
    sizes = described.select("h", F.size("at").alias("n")).orderBy("h").toArrow()
    held = np.cumsum(sizes.column("n").to_numpy())
    fits = int(np.searchsorted(held, MAX_FEATURES, "right"))
    if fits < len(held):
        described = described.where(F.col("h") < int(sizes.column("h")[fits].as_py()))
    taken = described.orderBy("h", "doc_id", "code").toArrow()
    examples = [
        (np.asarray(a.values), np.asarray(v.values, np.float64)) for a, v in zip(taken.column("at"), taken.column("value"), strict=True)
    ]
    odds = np.array([max(-12.0, min(12.0, labels.log_odds(c))) for c in taken.column("code").to_pylist()])
    scorer = train(examples, 1 / (1 + np.exp(-odds)), buckets)
    del taken, examples
    give_back()
    return QualityModel(labels, scorer)


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, posterior, score (1: good), kept, low_votes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(LABELLERS)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        judged = [shared.value.judge(x) for x in texts_of(batch.column(1))]
        low = [[n for n, d in zip(names, digits(c), strict=True) if d == LOW] for c, _, _ in judged]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([p for _, p, _ in judged]), pa.array([s for _, _, s in judged]), pa.array([s >= threshold for _, _, s in judged]), pa.array(low, pa.list_(pa.string()))],
            ["doc_id", "posterior", "score", "kept", "low_votes"],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, step, "doc_id long, posterior double, score double, kept boolean, low_votes array<string>")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", *, threshold: float = 0.5) -> DataFrame:
    """``docs`` whose score reaches ``threshold``, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    return keep_rows(docs, lambda batch: [shared.value.judge(x)[2] >= threshold for x in texts_of(batch.column(at))])
