import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from corpus_fixtures import ODD, prose
from pyspark.sql import functions as F

from rowtide.llm import common, exact_dedup, pq_neardup, simhash
from rowtide.llm.components import connected_components


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (300, 301), (301, 300)] + [(rng.randrange(500, 560), rng.randrange(500, 560)) for _ in range(50)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == brute_components({x for p in real for x in p}, real)
    assert connected_components(df.where("false")).collect() == []


CLASHES = ("kept", "full_hash", "__hash", "__id", "__lost", "__of", "row", "word", "bit", "digest", "n_bytes", "listed", "group", "fp", "node")


def clashing(docs):
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


CASES = [*enumerate(ODD), (50, ""), (51, "word"), (52, "word"), (53, "worm"), (52, "word"), (None, "nobody"), (None, "word"), (60, "a" * 100 + "b"), (61, "a" * 100 + "c"), (62, "a" * 100 + "b"), (3, "same id, other text"), (None, "alone")]


@pytest.mark.parametrize("words", [1, common.MARK_WORDS])
def test_exact_groups(documents, monkeypatch, words):
    """The same rows, digests included, whether the bitmaps are crowded or not."""
    monkeypatch.setattr(common, "MARK_WORDS", words)
    rows = CASES + [(1000 + i, "hot") for i in range(200)]
    some = exact_dedup.exact_groups(documents(rows)).select("doc_id", "keep_id", "group_size", "kept", "full_hash")
    want = [(i, k, n, kept, digest if n > 1 else None) for i, k, n, kept, digest in brute_exact(rows)]
    assert sorted(map(tuple, some.collect()), key=repr) == sorted(want, key=repr)
    got = exact_dedup.exact_groups(documents(rows), digest_all=True)
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "full_hash").collect()), key=repr) == brute_exact(rows)
    assert exact_dedup.exact_groups(documents([])).collect() == []


def test_only_survivors_are_read_whole(documents):
    rows = [(1, "abc"), (2, "abd"), (3, "abc"), (4, "long text alone")]
    got = {r["doc_id"]: r["full_hash"] is not None for r in exact_dedup.exact_groups(documents(rows)).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_each_stage_judges_what_the_one_before_left(documents):
    rows = [(1, "alone in its length"), (2, "a" * 80), (3, "b" * 80), (4, "c" * 70 + "d"), (5, "c" * 70 + "e"), (6, "c" * 70 + "d"), (7, None)]
    found = exact_dedup.refined(documents(rows)).collect()
    assert {r["doc_id"] for r in found if r["prefix_hash"] is not None} == {2, 3, 4, 5, 6}
    assert {r["doc_id"] for r in found if r["full_hash"] is not None} == {4, 5, 6}


def test_dropping_copies_keeps_every_text_once(documents):
    docs = clashing(documents(CASES))
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    texts = [r["text"] or "" for r in left.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in CASES})


def brute_fingerprint(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    found = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_are_those_of_the_definition(spark):
    rng = random.Random(2)
    for t in [x or "" for x in ODD] + [prose(rng, n) for n in (2, 3, 4, 50, 500)]:
        assert simhash.fingerprint(t) % (1 << 64) == brute_fingerprint(t)
    row = spark.createDataFrame([("the of and",)], "t string").select(F.xxhash64("t")).first()[0]
    assert row % (1 << 64) == xxhash.xxh64_intdigest(b"the of and", 42)


def near_prints(rng, centres=40, around=25):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        out.add(c)
        for _ in range(rng.randrange(around)):
            x = c
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
            out.add(x)
    return out


@pytest.mark.parametrize(("segments", "bucket"), [(4, 256), (8, 256), (16, 256), (8, 2), (8, 8)])
def test_links_lose_no_pair(spark, segments, bucket):
    prints = sorted(near_prints(random.Random(segments))) + [0, 1, 3, (1 << 64) - 1]
    prints = sorted(set(prints))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {tuple(sorted((a % (1 << 64), b % (1 << 64)))) for a, b in simhash.fingerprint_links(df, segments=segments, bucket=bucket).collect()}
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 2}
    assert got <= want
    if bucket == 256:
        assert got == want
    assert brute_components(prints, got) == brute_components(prints, want)


@pytest.mark.parametrize(("distance", "bucket"), [(1, 4), (3, 256), (3, 3), (4, 5)])
def test_links_at_other_distances(spark, distance, bucket):
    prints = sorted(near_prints(random.Random(distance), centres=15) | {0, 1, 3, (1 << 64) - 1})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    found = simhash.fingerprint_links(df, distance=distance, segments=8, bucket=bucket).collect()
    got = sorted(tuple(sorted((a % (1 << 64), b % (1 << 64)))) for a, b in found)
    assert got == [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= distance]


def test_near_groups(documents):
    rng = random.Random(6)
    rows = list(CASES)
    for k in range(12):
        base = prose(rng, 300).split()
        for j in range(rng.randrange(1, 6)):
            copy = list(base)
            if j:
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((100 + 10 * k + j, " ".join(copy)))
    got = simhash.near_groups(documents(rows)).collect()
    prints = [brute_fingerprint(t or "") for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    part = brute_components(range(len(rows)), links)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[part[n]] = min(least.get(part[n], i), i)
    want = [(i, f"{prints[n]:016x}", least.get(part[n])) for n, (i, _) in enumerate(rows)]
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr) == sorted(want, key=repr)
    docs = clashing(documents(rows))
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    left = left.collect()
    assert len(left) == len(set(part.values())) and all(r[c] == f"own {c}" for r in left for c in CLASHES)
    assert simhash.near_groups(docs.where("false")).collect() == []


def brute_vectors(rows, cosine=0.98):
    ok = [(n, np.array(v, float)) for n, (_, v, label) in enumerate(rows) if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for a, x in ok for b, y in ok if a < b and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine]
    part = brute_components(range(len(rows)), links)
    return sorted((rows[n][0], sum(n in p for p in links), rows[part[n]][0], part[n] == n) for n in range(len(rows)))


@pytest.mark.parametrize(("block", "per_list", "crowd", "lists"), [(1024, 8, None, 512), (16, 20, None, 512), (64, 2048, None, 512), (16, 4, 12, 2), (8, 8, 5, 3)])
def test_near_vectors_against_brute_force(spark, monkeypatch, block, per_list, crowd, lists):
    if crowd:  # several levels of lists, placed in several slices
        monkeypatch.setattr(pq_neardup, "PLACED_AT_ONCE", 7)
    rng = np.random.default_rng(block)
    rows = []
    for k in range(30):
        centre = rng.normal(size=24)
        for _ in range(rng.integers(1, 14)):
            rows.append((len(rows), [float(x) for x in (centre + rng.normal(size=24) * rng.choice([0.02, 0.12, 0.2])).astype(np.float32)], int(k % 3)))
    n = len(rows)
    rows += [(n, rows[0][1], 0), (n + 1, [2 * x for x in rows[0][1]], 0), (n + 2, None, 0), (n + 3, [0.0] * 24, 0), (n + 4, [1.0, None] * 12, 0), (n + 5, [float("nan")] * 24, 0), (n + 6, [float("inf")] * 24, 0), (n + 7, rows[0][1], None), (n + 8, [1.0, 2.0], 0), (n + 9, [1.0, 2.0], 0), (n + 10, [], 0), (n + 11, rows[0][1], 0)]
    df = spark.createDataFrame([(i, v, label, "clash") for i, v, label in rows], "vec_id long, embedding array<float>, label int, rep string").repartition(3)
    got = pq_neardup.near_vectors(df, block=block, rows_per_list=per_list, crowd=crowd, max_lists=lists)
    assert sorted(map(tuple, got.collect())) == brute_vectors(rows)


def test_lists_are_gone_through_in_waves(spark, monkeypatch):
    """So that only so many copies of a vector lie on disk at once."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in (rng.normal(size=3) + (2 if i % 2 else 0)).astype(np.float32)], i % 2) for i in range(400)]
    placed, deleted = [], []
    monkeypatch.setattr(pq_neardup, "part_crowded", lambda p, *a, f=pq_neardup.part_crowded: placed.append(p.count()) or f(p, *a))
    monkeypatch.setattr(pq_neardup, "forget", lambda *frames, f=pq_neardup.forget: deleted.append(len(frames)) or f(*frames))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, pq_neardup.near_vectors(df, rows_per_list=10, copies=1).collect()))
    assert got == brute_vectors(rows)
    assert len(placed) > 1 and sum(placed) > len(rows) and max(placed) < sum(placed) and len(deleted) == len(placed)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert pq_neardup.near_vectors(df).collect() == []
    only = spark.createDataFrame([(1, None, 1), (None, [1.0], 1)], df.schema)
    assert sorted(map(tuple, pq_neardup.near_vectors(only).collect()), key=repr) == [(1, 0, 1, True), (None, 0, None, True)]
