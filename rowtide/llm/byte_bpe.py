"""Byte-level BPE with vectorised pre-tokenisation.

A batch of texts becomes one array of codepoints, that array one of symbols (letter,
number, space, other white space, apostrophe before a contraction ending, other).
Each symbol is a transition function over the scanner's states.  The functions are
closed under composition into a small table of all that can arise, so composing is
one table lookup and associative; a blocked prefix scan yields the state before
every codepoint, and the boundaries follow from state, symbol and the symbol after.
No regular expression runs.  The slices between boundaries feed the pair merger,
whose results are cached; their offsets are kept for decoding single spans.  A text longer
than ``SCAN_CHARS`` is scanned part by part, each from the state that the one before left,
so that only its ids and offsets are held whole.

Defined cases: a null text counts as empty; special strings are ordinary text; any
Unicode text of any length round-trips; rows are independent, repeats and ties included; an empty
table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts_of

#: Codepoints scanned at once.
SCAN_CHARS = 1 << 19
#: Slices whose ids are cached in a worker; the cache then starts afresh.
CACHE_SLICES = 800_000

# Symbols of the scan.
LETTER, NUMBER, BLANK, SPACE, OTHER, SHORT, LONG, START = range(8)
# States: nothing open, one blank waiting, letters, numbers, others, white space,
# one or two more letters of a contraction.
NONE, WAIT, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, ONE_MORE, TWO_MORE = range(8)
_SEPARATOR = "\udc00"  # never part of a text that came from UTF-8


@lru_cache(maxsize=1)
def codepoint_classes() -> np.ndarray:
    """LETTER, NUMBER, BLANK, SPACE or OTHER for every codepoint."""
    classes = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            classes[c] = LETTER
        elif kind == "N":
            classes[c] = NUMBER
    # The codepoints of Unicode property White_Space.
    for a, b in ((9, 13), (32, 32), (133, 133), (160, 160), (5760, 5760), (8192, 8202), (8232, 8233), (8239, 8239), (8287, 8287), (12288, 12288)):
        classes[a : b + 1] = SPACE
    classes[32] = BLANK
    classes[ord(_SEPARATOR)] = START
    return classes


def _next_state(state: int, symbol: int) -> int:
    if symbol == START:
        return NONE
    if state == TWO_MORE:
        return ONE_MORE
    if state == ONE_MORE:
        return NONE
    if symbol in (SHORT, LONG):
        if state in (WAIT, IN_OTHERS):
            return IN_OTHERS
        return ONE_MORE if symbol == SHORT else TWO_MORE
    return {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, BLANK: WAIT, SPACE: IN_SPACE, OTHER: IN_OTHERS}[symbol]


@lru_cache(maxsize=1)
def transition_monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, composition table, image of each function and state).

    ``table[f, g]`` is "f, then g".
    """
    base = [tuple(_next_state(s, c) for s in range(8)) for c in range(8)]
    known = {tuple(range(8)): 0}
    queue = [tuple(range(8))]
    for f in queue:
        for g in base:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                queue.append(h)
    table = np.empty((len(queue), len(queue)), np.uint16)
    for i, f in enumerate(queue):
        for j, g in enumerate(queue):
            table[i, j] = known[tuple(g[s] for s in f)]
    return np.array([known[b] for b in base], np.uint16), table, np.array(queue, np.uint8)


def _scan(functions: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Prefix compositions (each position's own function included)."""
    n, size = len(functions), len(table)
    flat = table.ravel()
    if n <= 64:
        out = np.empty(n, np.uint16)
        held = 0
        for i, f in enumerate(functions.tolist()):
            held = int(table[held, f])
            out[i] = held
        return out
    rows = max(8, int(n**0.5) // 4)
    lanes = -(-n // rows)
    grid = np.zeros(rows * lanes, np.uint16)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(lanes, rows).T)
    for r in range(1, rows):
        grid[r] = flat[grid[r - 1].astype(np.intp) * size + grid[r]]
    before = np.zeros(lanes, np.uint16)
    before[1:] = _scan(grid[-1], table)[:-1]
    whole = flat[before.astype(np.intp)[None, :] * size + grid]
    return whole.T.ravel()[:n]


def boundaries(codepoints: np.ndarray, opening: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """True where a slice begins, and the state after each codepoint; texts are set off by
    separators, which begin a slice too.  ``opening`` is the state that an earlier part of
    the same text left; the last two codepoints then count as looked at only."""
    n = len(codepoints)
    symbols = codepoint_classes()[codepoints]
    if not n:
        return np.zeros(0, bool), np.zeros(0, np.uint8)
    before = NONE if opening is None else opening
    kinds = symbols.copy()
    for at in np.flatnonzero(codepoints == 39).tolist():
        one = chr(codepoints[at + 1]) if at + 1 < n else ""
        two = one + (chr(codepoints[at + 2]) if at + 2 < n else "")
        if one in ("s", "t", "m", "d"):
            symbols[at] = SHORT
        elif two in ("re", "ve", "ll"):
            symbols[at] = LONG
    own, table, images = transition_monoid()
    after = images[_scan(own[symbols], table), before]
    state = np.empty(n, np.uint8)
    state[0] = before
    state[1:] = after[:-1]
    following = np.full(n, START, np.uint8)
    following[:-1] = kinds[1:]
    is_space = (kinds == BLANK) | (kinds == SPACE)
    in_space = (state == WAIT) | (state == IN_SPACE)
    # White space opens a slice after anything else, and its last character leaves the
    # run when something that is no white space follows.
    last = (following != BLANK) & (following != SPACE) & (following != START)
    begins = is_space & (~in_space | last)
    joined = np.where(kinds == LETTER, IN_LETTERS, np.where(kinds == NUMBER, IN_NUMBERS, IN_OTHERS))
    begins |= ~is_space & (state != WAIT) & (state != joined)
    begins &= ~((state == ONE_MORE) | (state == TWO_MORE))
    begins |= kinds == START
    # Behind a separator and at the beginning everything begins.
    begins[0] |= opening is None
    begins[1:] |= kinds[:-1] == START
    return begins, after


def slices(texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
    """For each text its pre-token strings and their offsets (in codepoints)."""
    out: list[tuple[list[str], np.ndarray]] = []
    group: list[str] = []
    size = 0
    for x in texts:
        if group and size + len(x) > SCAN_CHARS:
            out.extend(_cut_group(group))
            group, size = [], 0
        group.append(x)
        size += len(x) + 1
    if group:
        out.extend(_cut_group(group))
    return out


def _cut_group(group: list[str]) -> list[tuple[list[str], np.ndarray]]:
    joined = _SEPARATOR.join(group)
    codepoints = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.flatnonzero(boundaries(codepoints)[0])
    out, base = [], 0
    for x in group:
        a, b = np.searchsorted(starts, (base, base + len(x)))
        offsets = starts[a:b] - base
        at = offsets.tolist()
        out.append(([x[i:j] for i, j in zip(at, [*at[1:], len(x)], strict=True)] if at else [], offsets))
        base += len(x) + 1
    return out


def long_slices(text: str) -> Iterator[tuple[list[str], np.ndarray]]:
    """The slices of one long text and their offsets, part by part."""
    state, opened = None, 0
    for at in range(0, len(text), SCAN_CHARS):
        size = min(SCAN_CHARS, len(text) - at)
        codepoints = np.frombuffer(text[at : at + size + 2].encode("utf-32-le"), "<u4")
        begins, after = boundaries(codepoints, state)
        starts = np.flatnonzero(begins[:size]) + at
        state = int(after[size - 1])
        edges = np.concatenate(([opened], starts if at else starts[1:]))
        if at + size == len(text):
            edges = np.append(edges, len(text))
        marks = edges.tolist()
        yield [text[i:j] for i, j in zip(marks, marks[1:], strict=False)], edges[:-1]
        opened = marks[-1]


class BytePairCodec:
    """Encoder and decoder over a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], cache: int = CACHE_SLICES):
        self.ranks = ranks
        self.pieces = {i: b for b, i in ranks.items()}
        self.cache: dict[str, bytes] = {}
        self.size = cache

    @classmethod
    def from_file(cls, path: str) -> BytePairCodec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the neighbouring pair of least rank merges, leftmost first."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 128:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            least = min(pairs)
            if least == 1 << 40:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 40)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 40)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap over a linked list, for very long slices."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        before, alive = list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if before[i] >= 0 and (r := ranks.get(piece[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode_texts(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """For each text its ids (little-endian unsigned 32-bit) and the slices' offsets."""
        short = [x for x in texts if len(x) <= SCAN_CHARS]
        coded = iter([(self._ids(pieces), offsets) for pieces, offsets in self._known(slices(short))])
        return [next(coded) if len(x) <= SCAN_CHARS else self._encode_long(x) for x in texts]

    def _known(self, cut: list[tuple[list[str], np.ndarray]]) -> list[tuple[list[str], np.ndarray]]:
        """``cut``, with the ids of all its slices in the cache."""
        if len(self.cache) > self.size:
            self.cache.clear()
        cache = self.cache
        for s in set().union(*(p for p, _ in cut)) if cut else ():
            if s not in cache:
                cache[s] = np.array(self.merge(s.encode("utf-8")), "<u4").tobytes()
        return cut

    def _ids(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.cache.__getitem__, pieces))

    def _encode_long(self, text: str) -> tuple[bytes, np.ndarray]:
        ids, offsets = bytearray(), []
        for part in long_slices(text):
            ((pieces, at),) = self._known([part])
            ids += self._ids(pieces)
            offsets.append(at)
        return bytes(ids), np.concatenate(offsets)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_texts([text])[0][0], "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_codecs: dict[tuple[str, int], BytePairCodec] = {}


def codec(path: str) -> BytePairCodec:
    key = (path, os.getpid())
    if key not in _codecs:
        _codecs[key] = BytePairCodec.from_file(path)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<long>, slice_offsets array<int>: whole encodings, per row."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        coded = codec(ranks_path).encode_texts(texts_of(batch.column(1)))
        ids = [np.frombuffer(a, "<u4").astype(np.int64) for a, _ in coded]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array([o.astype(np.int32) for _, o in coded], pa.list_(pa.int32()))],
            ["doc_id", "ids", "slice_offsets"],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, step, "doc_id long, ids array<long>, slice_offsets array<int>")


def decode_documents(coded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded binary; null ids decode to nothing, an unknown id fails the job."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(ranks_path)
        out = [c.decode(x or ()) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return map_arrow(coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col)), step, "doc_id long, decoded binary")


def encoding_digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode the ids."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(ranks_path)
        n, ids, decoded = [], [], []
        for coded, _ in c.encode_texts(texts_of(batch.column(1))):
            n.append(len(coded) // 4)
            ids.append(hashlib.sha256(coded).hexdigest())
            back = hashlib.sha256()
            for at in range(0, len(coded), 4 * SCAN_CHARS):
                back.update(c.decode(np.frombuffer(coded[at : at + 4 * SCAN_CHARS], "<u4").tolist()))
            decoded.append(back.hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
