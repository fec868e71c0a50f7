"""Exact token counts of whole texts, huge ones by overlap resynchronisation.

Texts up to ``chunk_chars`` go to the tokenizer as they are.  A longer text is
encoded in chunks that overlap; two neighbours are spliced at a position that both
have as a token boundary and that is proven stable: a white-space character right
after one that is none.  No match of the byte-level pattern runs over such a
position (only the last match before it looks ahead, and it ends there), and no
added token holds white space, so the tokens left of it do not depend on what
follows and those right of it not on what came before.  Where an overlap holds no
such position it is widened, twofold each time, to the end of the text if need be.

Defined cases: a null text counts as empty (no bytes, no tokens); repeated rows and
ids are counted one by one; an empty table gives an empty result; extra columns are
not looked at.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts_of

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 256
#: What str.isspace and the pattern's white-space class agree on; others are never used.
_PLAIN_SPACE = frozenset(" \t\n\r\x0b\x0c")
_loaded: dict[tuple[str, int], object] = {}


def tokenizer(path: str):
    """The library's tokenizer for a .json or .model file, loaded once in a worker."""
    key = (path, os.getpid())
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            _loaded[key] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            _loaded[key] = Tokenizer.from_file(path)
    return _loaded[key]


def _boundaries(encoding, base: int) -> tuple[list[int], dict[int, int]]:
    """Start of each token in the text, and for each start the first token having it."""
    starts = [base + a for a, _ in encoding.offsets]
    first: dict[int, int] = {}
    for i, a in enumerate(starts):
        first.setdefault(a, i)
    return starts, first


def _stable(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] in _PLAIN_SPACE and not text[at - 1].isspace()


def count_spliced(text: str, encode, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text``; ``encode`` gives an encoding with offsets for a string."""
    if len(text) <= chunk:
        return len(encode(text).ids)
    total, begin = 0, 0  # all tokens before the stable position ``begin`` are counted
    while True:
        core_end, reach = begin + chunk, overlap
        if core_end + reach >= len(text):
            return total + len(encode(text[begin:]).ids)
        while True:
            end = min(len(text), core_end + reach)
            left = encode(text[begin:end])
            if end == len(text):
                return total + len(left.ids)
            right = encode(text[core_end:end])
            _, in_left = _boundaries(left, begin)
            _, in_right = _boundaries(right, core_end)
            common = [p for p in in_left if core_end < p < end and p in in_right and _stable(text, p)]
            if common:
                begin_next = min(common)
                total += in_left[begin_next]
                begin = begin_next
                break
            reach *= 2


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    limit: int = 1024,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    ``tokenizer_path`` must be readable on every executor.  Splicing needs offsets and
    a byte-level pattern, so ``.model`` files are encoded whole.
    """
    if chunk < 1 or overlap < 1:
        raise ValueError("chunk and overlap must be positive")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = tokenizer(tokenizer_path)
        texts = texts_of(batch.column(1))
        if tokenizer_path.endswith(".model"):
            counts = [len(t.encode(x)) for x in texts]
        else:
            counts = [0] * len(texts)
            short = [i for i, x in enumerate(texts) if len(x) <= chunk]
            for i, e in zip(short, t.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True):
                counts[i] = len(e.ids)
            for i, x in enumerate(texts):
                if len(x) > chunk:
                    counts[i] = count_spliced(x, lambda s: t.encode(s, add_special_tokens=False), chunk, overlap)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = map_arrow(rows, step, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
