import random
import time
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from corpus_fixtures import ODD, WORDS, prose
from pyspark.sql import functions as F
from test_dedup import brute_components

from rowtide.llm import common, overlap, simhash

#: Many different words, so that shingles are not shared by chance.
LEXICON = [a + b + c for a in WORDS for b in ("", "en", "ish", "or") for c in ("", "s", "ly")]


def shingles(text, words=5):
    found = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def near_rows(rng):
    rows = list(enumerate(ODD)) + [(None, "nobody"), (30, "nobody"), (31, "a b c d e f"), (31, "another text of this id")]
    for k in range(25):
        base = rng.choices(LEXICON, k=rng.randrange(40, 250))
        for j in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(7) if j else 0):
                copy[rng.randrange(len(copy))] = rng.choice(LEXICON)
            rows.append((100 + 20 * k + j, " ".join(copy)))
    passage = rng.choices(LEXICON, k=60)
    return rows + [(1000 + i, " ".join(passage + rng.choices(LEXICON, k=rng.randrange(5, 60)))) for i in range(60)]


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    alike = [(a, b) for a in range(len(rows)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return brute_components(range(len(rows)), alike)


@pytest.mark.parametrize(("block", "counts"), [(512, 200_000), (3, 0)])
def test_groups_are_those_of_all_pairs(documents, monkeypatch, block, counts):
    monkeypatch.setattr(overlap, "MAX_COUNTS", counts)
    rows = near_rows(random.Random(7))
    part = brute_groups(rows)
    assert len(set(part.values())) < len(rows) - 40
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[part[n]] = min(least.get(part[n], i), i)
    want = sorted(((i, least.get(part[n])) for n, (i, _) in enumerate(rows)), key=repr)
    got = overlap.near_groups(documents(rows), block=block).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_the_stage_drops_near_copies(spark, documents):
    rng = random.Random(3)
    base = prose(rng, 181).split()
    base = [w + str(n) for n, w in enumerate(base)]
    copy = list(base)
    copy[40] = copy[120] = "edited"
    rows = [(1, " ".join(base)), (2, " ".join(copy)), (3, prose(rng, 200)), (4, None)]
    docs = documents(rows)
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4]
    assert corpus_pipeline.drop_near_copies(spark, docs.where("false"), "").collect() == []


def test_sketches_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(-(1 << 62), 1 << 62, n)) for n in (0, 1, 40, 1500, 2100, 5000, 9000)]
    sets += [np.unique(np.concatenate((x[len(x) // 9 :], rng.integers(-(1 << 62), 1 << 62, len(x) // 9)))) for x in sets]
    pairs = [(x, y) for x in sets for y in sets]
    least = overlap.apart([overlap.sketch(x) for x, _ in pairs], [overlap.sketch(y) for _, y in pairs])
    true = [len(np.setxor1d(x, y)) for x, y in pairs]
    assert (least <= true).all()
    assert [n for n, (x, y) in zip(least, pairs, strict=True) if x is y] == [0] * len(sets)


def test_only_pairs_that_may_be_alike_have_their_sets_made(documents, monkeypatch):
    """Texts that share a long passage and are otherwise unlike: settled without whole sets."""
    rng = random.Random(2)
    passage = rng.choices(LEXICON, k=60)
    docs = documents([(i, " ".join(passage + rng.choices(LEXICON, k=150))) for i in range(40)])
    left = []
    monkeypatch.setattr(overlap, "possible", lambda *a, f=overlap.possible: left.append(f(*a)) or left[-1])
    monkeypatch.setattr(overlap, "forget", lambda *a: None)
    assert overlap.near_groups(docs).where("kept").count() == 40
    assert [x.count() for x in left] == [0, 0]


def test_what_is_written_apart_leaves_no_shuffle_and_a_bounded_guess(spark):
    folders = list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs())
    files = lambda: {f for d in folders for f in Path(d.getPath()).rglob("shuffle_*")}
    before = files()
    df = spark.range(1000).selectExpr("id % 77 AS k", "id AS v")
    for _ in range(4):
        df = common.cut(df.join(df.groupBy("k").agg(F.max("v").alias("m")), "k").where("v <= m").select("k", "v"))
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert df.count() == 1000 and df._jdf.queryExecution().logical().stats().sizeInBytes().bit_length() <= 63
    common.forget(df)


def test_the_stage_joins_fingerprints_and_loses_no_pair_beyond_them(documents, monkeypatch):
    """SimHash links are taken and checked; pairs that differ in more bits are found too."""
    rows = [(i, t) for i, t in near_rows(random.Random(9)) if i is not None]
    docs = documents(list(dict(rows).items()))
    joined, known, given = [], [], []
    monkeypatch.setattr(simhash, "similar_pairs", lambda prints, f=simhash.similar_pairs: given.append(f(prints)) or given[-1])
    monkeypatch.setattr(simhash, "fingerprint_links", lambda prints, f=simhash.fingerprint_links, **o: joined.append(o) or f(prints, **o))
    monkeypatch.setattr(overlap, "forget", lambda *a: None)
    monkeypatch.setattr(overlap, "confirmed", lambda pairs, *a, f=overlap.confirmed: known.append(f(pairs, *a)) or known[-1])
    left = corpus_pipeline.drop_near_copies(docs.sparkSession, docs, "")
    own = list(dict(rows).items())
    part = brute_groups(own)
    assert left.count() == len(set(part.values()))
    assert joined == [{"distance": simhash.WIDEST}]
    found = [{tuple(r) for r in x.collect()} for x in known]
    prints = {overlap.xxhash.xxh64_intdigest(overlap.shingle_set(t or "", 5).tobytes(), overlap.SEED): simhash.fingerprint(t or "", 5) for _, t in own}
    bits = lambda pair: ((prints[pair[0] % 2**64] ^ prints[pair[1] % 2**64]) % 2**64).bit_count()
    near = {tuple(r) for r in given[0].collect()}
    assert near and {p for p in near if bits(p) <= simhash.WIDEST} == near and near & found[0]
    assert any(bits(p) > simhash.WIDEST for p in found[0] | found[1])


def test_later_stages_do_not_keep_an_earlier_model(spark):
    """A worker that scored toxicity drops the model when another operator's task begins."""
    import pyarrow as pa

    def held(batch):
        common.unpacked.setdefault("model", 1)
        return pa.RecordBatch.from_arrays([pa.array([len(common.unpacked)])], ["n"])

    rows = spark.range(8).repartition(1)
    assert common.map_arrow(rows, held, "n long", "model").first()["n"] == 1
    look = lambda batch: pa.RecordBatch.from_arrays([pa.array([len(common.unpacked)])], ["n"])
    assert common.map_arrow(rows, look, "n long").first()["n"] == 0


def test_workers_drop_what_packing_remembers(spark):
    """The words of a packing worker go when another operator's task begins."""
    import public_tokenizers
    import pyarrow as pa

    from rowtide.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = spark.range(8).repartition(1)
    count = lambda batch: pa.RecordBatch.from_arrays([pa.array([len(common.unpacked)])], ["n"])
    assert common.map_arrow(rows, lambda batch: packing.word_ids(path) and count(batch), "n long", path).first()["n"] == 1
    assert common.map_arrow(rows, count, "n long").first()["n"] == 0


def test_each_stage_begins_with_executors_at_rest(spark, documents, monkeypatch):
    done = []
    monkeypatch.setattr(corpus_pipeline, "rest", lambda s, f=common.rest: done.append(f(s)))
    for _, stage in corpus_pipeline.STAGES[2:]:
        assert stage(spark, documents([(1, "one two three")]), "").count() == 1
    assert len(done) == 3


def test_a_pair_meets_once_however_many_keys_it_shares(documents, monkeypatch):
    """A common passage gives many keys; texts that hold it are not joined at each of them."""
    rng = random.Random(4)
    rows = []
    for group in range(20):
        passage = rng.choices(LEXICON, k=60)
        rows += [(3 * group + i, " ".join(passage + rng.choices(LEXICON, k=150))) for i in range(3)]
    docs, given = documents(rows), []
    keep = lambda pairs, *a, f=overlap.confirmed: given.append(tuple(map(tuple, pairs.collect()))) or f(pairs, *a)
    monkeypatch.setattr(overlap, "confirmed", keep)
    judged = overlap._folds_near
    monkeypatch.setattr(overlap, "_folds_near", lambda *a: F.lit(True))
    assert overlap.near_groups(docs).where("kept").count() == 60
    assert len(given[1]) == len(set(given[1])) > 20
    monkeypatch.setattr(overlap, "_folds_near", judged)
    assert overlap.near_groups(docs).where("kept").count() == 60
    assert not given[3]


def test_folded_sketches_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(6)
    for n in (0, 1, 40, 600, 5000):
        common_part, x, y = (rng.integers(-(2**63), 2**63 - 1, m, np.int64) for m in (n, n // 9, n // 7))
        a, b = (np.unique(np.concatenate((common_part, z))) for z in (x, y))
        differ = int(np.bitwise_count((overlap.fold(overlap.sketch(a)) ^ overlap.fold(overlap.sketch(b))).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b))
