import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from corpus_fixtures import ODD, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowtide.llm import byte_bpe, packing, token_count


RANKS, JSON, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
CODEC = byte_bpe.BytePairCodec.from_file(RANKS)
with open(RANKS, "rb") as f:
    LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
BYTE, WORD = Tokenizer.from_file(JSON), Tokenizer.from_file(WORDS)
TEXT = st.text(alphabet=st.sampled_from("aàS'trevmld L1٣²\n\t .!é中́ \x1c🙂"), max_size=30) | st.text(max_size=20)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_encoding_is_the_librarys_and_round_trips(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()
    (pieces, offsets) = byte_bpe.slices([text])[0]
    assert "".join(pieces) == text and all(text[o:].startswith(p) for o, p in zip(offsets, pieces, strict=True))


def test_boundaries_of_a_batch_are_those_of_its_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab '1\n.s") for _ in range(rng.randrange(200))) for _ in range(300)]
    assert [p for p, _ in byte_bpe.slices(texts)] == [byte_bpe.slices([t])[0][0] for t in texts]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 20])
def test_long_texts_are_scanned_part_by_part(monkeypatch, size):
    rng = random.Random(size)
    parts = [*"abZ  \n\t'.,!1٣é漢🙂", "'s", "'re", "'ll", " '", "'t ", "  x", "\n\n"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(400)]
    whole = CODEC.encode_texts(texts)
    monkeypatch.setattr(byte_bpe, "SCAN_CHARS", size)
    for t, (ids, offsets), (long_ids, long_offsets) in zip(texts, whole, CODEC.encode_texts(texts), strict=True):
        assert long_ids == ids and long_offsets.tolist() == offsets.tolist()
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(t)


@pytest.mark.parametrize(
    "operator", [lambda d: packing.pack_documents(d, WORDS), lambda d: token_count.token_counts(d, JSON), lambda d: byte_bpe.encoding_digests(d, RANKS)]
)
def test_further_columns_do_not_matter(documents, operator):
    names = ("n_tokens", "n_bytes", "ids_sha256", "over_limit", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "rank", "slice", "n", "before")
    docs = documents([*enumerate(ODD), (None, None), (0, "again"), (0, "again")])
    clashing = docs.withColumns({c: F.lit("own") for c in names})
    assert sorted(map(tuple, operator(clashing).collect()), key=repr) == sorted(map(tuple, operator(docs).collect()), key=repr)
    assert operator(clashing.where("false")).collect() == []


def test_long_slices_and_a_small_cache():
    small = byte_bpe.BytePairCodec(CODEC.ranks, cache=5)
    for text in ("ab" * 3000, "🙂" * 400, prose(random.Random(1), 300), "x" * 129):
        assert small.encode(text) == LIBRARY.encode_ordinary(text)


def test_documents_encode_and_decode(documents):
    rows = list(enumerate([*ODD, "same", "same"])) + [(0, "again"), (None, "no id")]
    docs = documents(rows)
    got = byte_bpe.encoding_digests(docs, RANKS).collect()
    want = []
    for i, t in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    coded = byte_bpe.encode_documents(docs, RANKS)
    back = {(r["doc_id"], bytes(r["decoded"])) for r in byte_bpe.decode_documents(coded, RANKS).collect()}
    assert back == {(i, (t or "").encode()) for i, t in rows}
    assert byte_bpe.encoding_digests(docs.where("false"), RANKS).collect() == []


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 4), (64, 1), (7, 30)])
def test_spliced_counts_are_exact(chunk, overlap):
    rng = random.Random(5)
    encode = lambda s: BYTE.encode(s, add_special_tokens=False)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab '1\n. \t<|endoftext|>é") for _ in range(rng.randrange(400))) for _ in range(150)] + ["x" * 900, "a b" * 300, "  \n" * 200, prose(rng, 400)]
    for t in texts:
        assert token_count.count_spliced(t, encode, chunk, overlap) == len(encode(t).ids), t


def test_token_counts(documents):
    rows = list(enumerate(ODD)) + [(100, prose(random.Random(2), 3000)), (0, "repeated id"), (None, "x")]
    got = token_count.token_counts(documents(rows), JSON, chunk=500, overlap=16).collect()
    want = []
    for i, t in rows:
        n = len(BYTE.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    pieces = token_count.token_counts(documents([(1, "some words"), (2, None)]), P.path("piece_bpe_32k.model")).collect()
    assert {r["doc_id"]: r["n_tokens"] > 0 for r in pieces} == {1: True, 2: False}


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_word_ids_are_the_librarys(text):
    got = np.frombuffer(packing.word_ids(WORDS).of([text])[0], "<u4").tolist()
    assert got == WORD.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["A <|STARTOFTEXT|> b", "<|EndOfText|>", "<|EndOfText|> <|endoftext|> End.", "Ä<|EndOfText|>x É", "no <|ENDOFTEXT|>\nÏ <|startoftext|>s"])
def test_special_tokens_keep_their_case(text):
    got = np.frombuffer(packing.WordIds(WORDS).of([text, "plain <|endoftext|>", text.lower()])[0], "<u4").tolist()
    assert got == WORD.encode(text, add_special_tokens=False).ids


def test_plans_use_every_piece_once_and_fill_gaps():
    rng = random.Random(9)
    for n in (1, 5, 50, 3000):
        lengths = [min(2048, 1 + int(rng.expovariate(1 / 500))) for _ in range(n)]
        histogram = {x: lengths.count(x) for x in set(lengths)}
        plan = packing.Plan(histogram)
        seen: dict[int, list] = {}
        for g in plan.groups:
            assert 0 < g.used() <= 2048
            for length, rank in g.slots:
                seen.setdefault(length, []).extend(range(rank, rank + g.count))
        assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(c)) for k, c in histogram.items()}
        bound = -(-sum(lengths) // 2048)
        assert plan.sequences <= max(bound * 1.23 + 1, 1) and (n < 3000 or plan.sequences <= bound + 3)
    assert packing.Plan({1000: 2, 48: 1, 1048: 1, 300: 1, 700: 1}, 2048).sequences == 2
    assert packing.Plan({1500: 10**9}, 2048).sequences == 10**9
    assert packing.Plan({}, 2048).sequences == 0
    with pytest.raises(ValueError):
        packing.Plan({0: 1})


@pytest.mark.parametrize("at_once", [None, 3])
def test_packed_documents(documents, at_once):
    rng = random.Random(4)
    rows = list(enumerate(ODD)) + [(50 + i, prose(rng, rng.randrange(1, 400))) for i in range(60)] + [(200 + i, "the same short text") for i in range(40)] + [(300, "one two"), (300, "one two"), (None, "x"), (400, prose(rng, 900))]
    cut = packing.pieces(documents(rows), WORDS, capacity=256)
    got = packing.pack(cut, capacity=256, ranked_at_once=at_once).collect()
    want = []
    for i, t in rows:
        ids = [*WORD.encode(t or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 256)):
            part = ids[a : a + 256]
            want.append((i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    at: dict[int, list] = {}
    for r in got:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    assert len(at) <= -(-sum(w[3] for w in want) // 256) * 1.1 + 1
    assert packing.pack_documents(documents([]), WORDS).collect() == []
