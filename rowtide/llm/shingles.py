"""Hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
#: Shingles whose bits are counted at a time.
_SLICE = 1 << 14
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included (fewer words: one run)."""
    found = text.encode("utf-8").translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)],
        np.uint64,
    )


def simhash(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash: a bit is set if it is set in over half the shingles."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = hashes[at : at + _SLICE]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])
