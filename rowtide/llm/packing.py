"""Best-fit packing by exact-complement hashing.

Pieces of equal length are interchangeable, so the plan is made over the histogram
of lengths (at most ``capacity`` entries, whatever the corpus) and says how often a
combination of lengths is used: full pieces stand alone; then, from the longest
length down, the gap it leaves is looked up among single lengths, sums of two and
sums of three, and a hit is consumed as often as the counts allow; what is left is
placed best-fit, longest first, in counted groups of equal gaps.  A plan step holds
for a run of ranks of a length, so pieces find their place by their rank among the
pieces of that length.  Ranks are counted in salted slices of bounded size, hence no length,
however common, has to pass through one task.

Defined cases: a null text counts as empty and makes one piece holding only the end
id; longer documents alone are cut; repeated rows (and repeated ids) are packed one
by one, told apart by their order of rank alone; an empty table gives
an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, texts_of, unpacked
from .token_count import tokenizer

CAPACITY = 2048
#: Pieces of one length that are ranked in one task: a thousandth of all, but at most
#: the first number and not less than the second.
RANKED_AT_ONCE = (1_000_000, 250)
#: Words whose ids are cached in a worker; the cache then starts afresh.
CACHE_WORDS = 1_200_000


#: Marks that stand behind a word and are a match of their own in the library's pattern.
_MARKS = ".,;:!?%$#&*|+=~^@)]}>"


class WordIds:
    """Ids by the tokenizers library, word by word.

    The library's normaliser and pattern never join what a space or a line feed parts,
    so a text's ids are those of its space-separated words in order.  Words of letters
    only are handed to the library many at a time and told apart by the word-end mark.
    Added tokens match the raw text only, so a text that holds one once lowered, but is
    not lower-case itself, keeps its case.
    """

    def __init__(self, path: str, cache: int = CACHE_WORDS):
        self.library = tokenizer(path)
        self.size = cache
        self.cache: dict[str, bytes] = {"": b""}
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")

    def _letters(self, words: list[str]) -> None:
        """Words of letters that the normaliser maps one by one: a token run each."""
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                coded, a = ids.tobytes(), 0
                for w, b in zip(part, (stops * 4).tolist(), strict=True):
                    self.cache[w] = coded[a:b]
                    a = b
            else:
                self._one_by_one(part)

    def _one_by_one(self, words: list[str]) -> None:
        for w, e in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.cache[w] = np.array(e.ids, "<u4").tobytes()

    def of(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, little-endian unsigned 32-bit."""
        if len(self.cache) > self.size:
            self.cache.clear()
            self.cache[""] = b""
        cache = self.cache
        split, latin, other = [], [], []
        for x in texts:
            try:
                x.encode("latin-1")  # there, lowering commutes with the normaliser
                low = x.lower()
                if low != x and any(t in low for t in self.added):
                    kind = other
                else:
                    x, kind = low, latin
            except UnicodeEncodeError:
                kind = other
            words = x.replace("\n", " ").split(" ")
            split.append(words)
            kind.append(words)
        letters, marked, odd = set(), [], set()
        for w in set().union(*latin).difference(cache):
            bare = w.rstrip(_MARKS)
            if bare.isalpha():
                if len(bare) < len(w):
                    marked.append((w, bare, w[len(bare) :]))
                    odd.add(w[len(bare) :])
                letters.add(bare)
            else:
                odd.add(w)
        self._letters([w for w in letters if w not in cache])
        self._one_by_one(list(odd.union(*other).difference(cache)))
        for w, bare, marks in marked:
            cache[w] = cache[bare] + cache[marks]
        return [b"".join(map(cache.__getitem__, words)) for words in split]


def word_ids(path: str) -> WordIds:
    """The ids that this worker remembers, until a task begins that does not use them."""
    if path not in unpacked:
        unpacked[path] = WordIds(path)
    return unpacked[path]


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    capacity: int = CAPACITY,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of every piece."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, piece, start, length, crc, ids = [], [], [], [], [], []
        for i, coded in zip(batch.column(0).to_pylist(), word_ids(tokenizer_path).of(texts_of(batch.column(1))), strict=True):
            whole = memoryview(coded + end)
            for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                part = whole[at : at + 4 * capacity]
                doc.append(i)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(np.frombuffer(part, "<u4").astype(np.int64))
        out = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            out, names = [*out, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(out, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, step, schema, tokenizer_path)


@dataclass
class Group:
    """``count`` sequences with the same content: (length, first rank) of each slot."""

    base: int
    count: int
    slots: list[tuple[int, int]] = field(default_factory=list)

    def used(self) -> int:
        return sum(n for n, _ in self.slots)


class Plan:
    """Which combinations of lengths are used, and how often."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        if any(n < 1 or n > capacity for n, c in histogram.items() if c):
            raise ValueError("lengths must lie between 1 and the capacity")
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for n, c in histogram.items():
            self.left[n] += c
        self.next_rank = [0] * (capacity + 1)
        self.groups: list[Group] = []
        self.sequences = 0
        self._complements()
        self._best_fit()

    def _take(self, lengths: tuple[int, ...], count: int) -> Group:
        slots = []
        for n in lengths:
            slots.append((n, self.next_rank[n]))
            self.next_rank[n] += count
            self.left[n] -= count
        group = Group(self.sequences, count, slots)
        self.sequences += count
        return group

    def _times(self, lengths: tuple[int, ...]) -> int:
        return min(int(self.left[n]) // lengths.count(n) for n in set(lengths))

    def _find(self, gap: int, without: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to ``gap``, longest first."""
        left = self.left.copy()
        left[without] -= 1
        there = left > 0
        if there[gap]:
            return (gap,)
        if found := self._pair(there, left, gap):
            return found
        sizes = np.flatnonzero(there[1:gap]) + 1
        for a in sizes[::-1].tolist():
            if 3 * a < gap:
                break
            rest = gap - a
            left[a] -= 1
            there[a] = left[a] > 0
            found = self._pair(there, left, rest)
            left[a] += 1
            there[a] = True
            if found:
                return (a, *found)
        return None

    @staticmethod
    def _pair(there: np.ndarray, left: np.ndarray, total: int) -> tuple[int, int] | None:
        if total < 2:
            return None
        low = np.arange(1, total // 2 + 1)
        hit = there[low] & there[total - low]
        if total % 2 == 0:
            hit[-1] = left[total // 2] > 1
        at = int(np.argmax(hit))
        return (total - int(low[at]), int(low[at])) if hit[at] else None

    def _complements(self) -> None:
        full = self.capacity
        if self.left[full]:
            self.groups.append(self._take((full,), int(self.left[full])))
        for n in range(full - 1, 0, -1):
            while self.left[n] > 0:
                found = self._find(full - n, n)
                if not found:
                    break
                use = (n, *found)
                self.groups.append(self._take(use, self._times(use)))

    def _best_fit(self) -> None:
        """What no combination fills exactly: longest first into the tightest gap."""
        gaps: list[int] = []  # sorted; the groups with each gap
        by_gap: dict[int, list[Group]] = {}

        def put(group: Group) -> None:
            gap = self.capacity - group.used()
            if gap not in by_gap:
                by_gap[gap] = []
                bisect.insort(gaps, gap)
            by_gap[gap].append(group)

        for n in range(self.capacity - 1, 0, -1):
            while (count := int(self.left[n])) > 0:
                at = bisect.bisect_left(gaps, n)
                if at == len(gaps):
                    each = min(self.capacity // n, count)
                    put(self._take((n,) * each, count // each))
                    continue
                gap = gaps[at]
                group = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap], gaps[at]
                used = min(count, group.count)
                if used < group.count:
                    put(Group(group.base + used, group.count - used, [(m, r + used) for m, r in group.slots]))
                group.count = used
                group.slots.append((n, self.next_rank[n]))
                self.next_rank[n] += used
                self.left[n] -= used
                put(group)
        for held in by_gap.values():
            self.groups.extend(held)

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted by length and first rank: length, first rank, first sequence, offset."""
        rows = []
        for group in self.groups:
            offset = 0
            for n, rank in group.slots:
                rows.append((n, rank, group.base, offset))
                offset += n
        found = np.array(sorted(rows), np.int64).reshape(-1, 4)
        return tuple(np.ascontiguousarray(found[:, k]) for k in range(4))


def pack(cut_pieces: DataFrame, *, capacity: int = CAPACITY, ranked_at_once: int | None = None) -> DataFrame:
    """``cut_pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # At most ``capacity`` rows reach the driver.
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = Plan(histogram, capacity)
    ranked_at_once = ranked_at_once or min(RANKED_AT_ONCE[0], max(RANKED_AT_ONCE[1], sum(histogram.values()) // 1000))
    wide = {n: -(-c // ranked_at_once) for n, c in histogram.items() if c > ranked_at_once}
    spread = F.lit(1)
    if wide:
        spread = F.coalesce(F.create_map(*[F.lit(x).cast("long") for kv in wide.items() for x in kv])[F.col("length")], F.lit(1))
    sliced = cut_pieces.select(*columns, F.pmod(F.xxhash64("doc_id", "piece"), spread).alias("slice"))
    ranked = sliced.withColumn(
        "rank", F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")) - 1
    )
    if wide:
        # One row for each slice: capacity + pieces / ranked_at_once rows at most, a few MB.
        sizes = sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
        before = sizes.withColumn(
            "before", F.sum("n").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
        ).select("length", "slice", F.coalesce("before", F.lit(0)).alias("before"))
        ranked = ranked.join(F.broadcast(before), ["length", "slice"], "left").withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    length, rank, sequence, offset = plan.places()
    first = np.searchsorted(length, np.arange(capacity + 2))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, r = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        at = np.empty(len(n), np.int64)
        for k in np.unique(n):
            own = n == k
            a, b = first[k], first[k + 1]
            at[own] = a + np.searchsorted(rank[a:b], r[own], "right") - 1
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(sequence[at] + r - rank[at]), pa.array(offset[at])], [*columns, "sequence_id", "offset"]
        )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_arrow(ranked.select(*columns, F.col("rank").cast("long").alias("rank")), step, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY) -> DataFrame:
    """Cut, plan and place every document: one row per piece."""
    return pack(cut(pieces(docs, tokenizer_path, id_col, text_col, capacity=capacity)), capacity=capacity)
