import math
import os
import random
import re
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from corpus_fixtures import ODD, prose
from pyspark.sql import functions as F

from rowtide.llm import license_scan, toxicity, url_filter, weak_quality
from rowtide.llm.queries import ORACLE_SQL, QUERIES, RULES
from rowtide.llm.url_filter import Rule

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def link(*hosts):
    return "".join(f'<a href="https://{h}/x">y</a>' for h in hosts)


PAGE_ROWS = [
    (1, "https://a.example.net/en/1?q", link("good.example.org", "mid.example.com")),
    (2, "http://A.example.net/de/2", None),
    (3, "https://www.example.net/en/", ""),
    (4, "https://x.org/fr/page#top", link("mid.example.com", "x.org")),
    (5, "https://x.org", link("MID.example.com")),
    (6, "https://mid.example.com/en/", link("bad.net", "x.org", "bad.net")),
    (7, "https://bad.net/any", link("x.org")),
    (8, "https://farm.example.com/a", link("bad.net", "worse.net")),
    (9, "https://farm.example.com/de/a", '<a HREF = \'//worse.net/p\'>z</a>'),
    (10, None, link("bad.net")),
    (11, "mailto:nobody", "x"),
    (12, "https://notnet/x", None),
    (13, "https:///empty", None),
    (14, "https://b.example.com/de", None),
    (14, "https://b.example.com/de", None),
]


def brute_urls(rows, rules, damping=0.85, rounds=10, least=0.01):
    parts, links, per = [], Counter(), {}
    for _, url, html in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        host = raw.lower()
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fit, key=lambda r: len(r.text), default=None)
        parts.append((host, path, rule))
        if host:
            per.setdefault(host, []).append(rule.action if rule else None)
        for target in {t.lower() for t in re.findall(url_filter.LINK, html or "")}:
            if host and target != host:
                links[(host, target)] += 1
    seeds = {}
    for h, acts in per.items():
        if acts.count("block") * 2 >= len(acts):
            seeds[h] = "block"
        elif acts.count("allow") * 2 >= len(acts):
            seeds[h] = "allow"
    mass = {}
    for kind in ("allow", "block"):
        edges = links if kind == "allow" else {(b, a): w for (a, b), w in links.items()}
        own = [h for h, k in seeds.items() if k == kind]
        fresh = {h: (1 - damping) / len(own) for h in own}
        state = dict(fresh)
        for _ in range(rounds):
            new = dict(fresh)
            for (a, b), w in edges.items():
                total = sum(v for (x, _), v in edges.items() if x == a)
                if a in state:
                    new[b] = new.get(b, 0) + damping * state[a] * w / total
            state = new
        mass[kind] = state
    one = 1 / max(1, sum(k == "block" for k in seeds.values()))
    into = Counter()
    for (_, b), w in links.items():
        into[b] += w
    taken = Counter()
    for (a, b), w in links.items():
        taken[a] += w / into[b]
    out = []
    for (i, _, _), (host, path, rule) in zip(rows, parts, strict=True):
        bad = mass["block"].get(host, 0) > 0 and mass["block"][host] >= least * one * min(1, taken[host]) and mass["block"].get(host, 0) > mass["allow"].get(host, 0)
        out.append((i, host, path, rule.text if rule else None, rule.action if rule else "block" if bad else "allow"))
    return sorted(out, key=repr)


def test_urls_against_brute_force_and_sql(spark):
    pages = spark.createDataFrame(PAGE_ROWS, PAGES).withColumns({"host": F.lit("clash"), "verdict": F.lit(1)}).repartition(3)
    got = url_filter.judge_urls(pages, RULES)
    want = brute_urls(PAGE_ROWS, RULES)
    assert sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr) == want
    assert ("allow" not in {v for i, *_, v in want if i == 8}) and {v for i, *_, v in want if i == 12} == {"allow"}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGE_ROWS)
    assert sorted(con.execute(ORACLE_SQL["op1_url_filter"]).fetchall(), key=repr) == want


def test_a_hub_of_hundreds_of_linkers(spark):
    """Hosts that link to a blocked hub alone are blocked, however many they are."""
    rows = [(0, "https://hub.net/", "")] + [(i, f"https://l{i}.info/", link("hub.net")) for i in range(1, 401)]
    rows += [(1000 + i, f"https://c{i}.info/", link("fine.info")) for i in range(50)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(rows, PAGES), RULES).collect()}
    assert got == {i: "block" if i <= 400 else "allow" for i, _, _ in rows}


def test_many_rules_are_joined(spark):
    rng = random.Random(4)
    hosts = ["net", "a.net", "b.a.net", "com", "x.com", "org", "é.org"]
    rules = [Rule.parse(f"{rng.choice(hosts)}/{rng.choice(['', 'a', 'a/', 'a/b', 'c'])}", rng.choice(["allow", "block"])) for _ in range(40)]
    urls = spark.createDataFrame([(rng.choice(["net", "a.net", "c.b.a.net", "xnet", "y.x.com", "com", "", "é.org", "."]), rng.choice(["", "/", "/a", "/a/b/c", "/c?"])) for _ in range(300)], "host string, path string")
    few = url_filter.with_rules(urls, rules).select("host", "path", "rule").collect()
    many = url_filter.with_rules(urls, rules, expression_rules=0).select("host", "path", "rule").collect()
    assert sorted(map(tuple, few), key=repr) == sorted(map(tuple, many), key=repr) and any(r["rule"] for r in few)


def test_no_pages_and_no_rules(spark):
    empty = spark.createDataFrame([], PAGES)
    assert url_filter.judge_urls(empty, RULES).collect() == []
    assert {r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(PAGE_ROWS, PAGES), []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        Rule.parse("net/", "maybe")


@pytest.mark.parametrize("width", [60, 72, 80, 100, 10**6])
def test_wrapped_licences(spark, documents, width):
    """Whole licences at any width, with and without headers, are what they are unwrapped."""

    def wrapped(text):
        return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))

    headers = ["", "Copyright (c) 2020 Somebody\n\n", "Copyright 2019-2021 A, B and C\nAll rights reserved.\n\n", "(c) 2011 Else\n© Third\n\n"]
    whole = [(i, t) for i, t in license_scan.KNOWN if len(t) > 200]
    rows = [(100 * n + k, h + wrapped(t)) for n, (_, t) in enumerate(whole) for k, h in enumerate(headers)]
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(documents(rows), license_scan.registry(spark)).collect()}
    assert got == {100 * n + k: i for n, (i, _) in enumerate(whole) for k in range(len(headers))}


def test_known_digests_are_those_of_public_texts(spark, documents):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    files = {i: f"/usr/share/common-licenses/{f}" for i, f in files.items()}
    found = [(n, i, open(f, encoding="utf-8").read()) for n, (i, f) in enumerate(files.items()) if os.path.exists(f)]
    if not found:
        pytest.skip("no licence texts on this machine")
    rows = [(n, t) for n, _, t in found] + [(100 + n, re.sub(r"\bLICENSE\b", "LICENCE", t.upper())) for n, _, t in found] + [(200 + n, t + " more") for n, _, t in found]
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(documents(rows), license_scan.registry(spark)).collect()}
    assert got == {n: i for n, i, _ in found} | {100 + n: i for n, i, _ in found} | {200 + n: None for n, _, _ in found}


def test_spellings_count_as_whole_words(spark, documents):
    texts = ["the programmer labours", "licence licence  LICENCE,licence", "unfavourable favour", "sublicence"]
    forms = [r[0] for r in documents(list(enumerate(texts)), 1).orderBy("doc_id").select(license_scan.canonical(F.col("text"))).collect()]
    assert forms == ["the programmer labours", "license license license license", "unfavourable favor", "sublicence"]


def test_a_large_registry_finds_the_same(spark, documents, monkeypatch):
    rows = [(1, "prose\nReleased under the MIT License.\nReleased under the MIT License."), (2, "Licensed under CC BY 4.0."), (3, None), (None, "x\nLicensed under CC BY 4.0."), (None, "x\nLicensed under CC BY 4.0.")]
    few = license_scan.scan(documents(rows), license_scan.registry(spark)).collect()
    monkeypatch.setattr(license_scan, "LITERALS", 1)
    monkeypatch.setattr(license_scan, "BROADCAST_LICENSES", 1)
    many = license_scan.scan(documents(rows), license_scan.registry(spark)).collect()
    assert sorted(map(tuple, many), key=repr) == sorted(map(tuple, few), key=repr)
    assert {(r["doc_id"], r["n_notices"], r["notices"]) for r in few} == {(1, 2, "MIT"), (2, 0, ""), (3, 0, ""), (None, 1, "CC-BY-4.0")}


def test_license_forms(spark, documents):
    mit = license_scan.KNOWN[1][1]
    variants = [mit, mit.upper(), "Copyright (c) 2020 Somebody\n\n" + mit.replace("\n\n", "\n"), mit.replace('"', "“").replace("Software", "SOFTWARE"), mit + "\n\n© 2024 Else"]
    rows = [*enumerate(ODD), *((100 + i, v) for i, v in enumerate(variants)), (200, mit + " and more"), (201, "Some prose.\n  Released under the M.I.T. licence!\nmore\nReleased under the MIT Licence"), (202, "Released under the MIT License."), (202, "Released under the MIT License."), (203, "released UNDER the mit licence\nLicensed under CC BY-NC 4.0.")]
    docs = documents(rows).withColumn("license", F.lit("clash"))
    got = {r["doc_id"]: (r["license"], r["n_notices"], r["notices"]) for r in license_scan.scan(docs, license_scan.registry(spark)).collect()}
    assert all(got[100 + i][0] == "MIT" for i in range(len(variants)))
    assert got[200] == (None, 0, "")
    assert got[201] == (None, 1, "MIT") and got[202] == ("MIT", 0, "") and got[203] == (None, 2, "CC-BY-NC-4.0,MIT")
    assert all(got[i] == (None, 0, "") for i in range(len(ODD)))
    assert license_scan.scan(docs.where("false"), license_scan.registry(spark)).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_the_label_model_finds_who_is_right():
    rng = random.Random(3)
    names = list(weak_quality.LABELLERS)
    patterns = Counter()
    truth = {}
    for _ in range(4000):
        low = rng.random() < 0.15
        kind = rng.randrange(len(names)) if low else None  # found by a labeller and the next
        code = 0
        for n in range(len(names)):
            says_low = rng.random() < (0.003 if kind is None else 0.9 if (n - kind) % len(names) < 2 else 0.05)
            code = code * 3 + (weak_quality.LOW if says_low else weak_quality.GOOD)
        patterns[code] += 1
        truth.setdefault(code, Counter())[low] += 1
    model = weak_quality.estimate(patterns)
    wrong = sum(c[model.log_odds(code) >= 0] for code, c in truth.items())
    assert wrong < 0.04 * 4000
    assert all(0.5 < a <= 1 for a in model.accuracies().values())
    assert weak_quality.estimate({}).log_odds(0) < 0


def test_estimation_against_row_by_row_steps():
    """The same steps over rows instead of patterns, in plain loops."""
    rng = random.Random(12)
    k = len(weak_quality.LABELLERS)
    rows = [[rng.choice([0, 2, 1, 2]) if rng.random() < 0.3 else 2 for _ in range(k)] for _ in range(60)]
    codes = Counter(int("".join(map(str, r)), 3) for r in rows)
    low = [[0.01] * k] + [[0.9 if a == b else 0.1 for b in range(k)] for a in range(k)]
    first, shares = [list(x) for x in low], [0.85] + [0.15 / k] * k
    for _ in range(5):
        held = []
        for r in rows:
            p = [s * math.prod(1 if v == 1 else x if v == 0 else 1 - x for v, x in zip(r, lows, strict=True)) for s, lows in zip(shares, low, strict=True)]
            held.append([x / sum(p) for x in p])
        mass = [sum(h[c] for h in held) for c in range(k + 1)]
        shares = [(m + 1) / (len(rows) + k + 1) for m in mass]
        for c in range(k + 1):
            pseudo = 2 + weak_quality.ASSUMED * (len(rows) if c == 0 else mass[c])
            for j in range(k):
                bad = sum(h[c] for h, r in zip(held, rows, strict=True) if r[j] == 0) + pseudo * first[c][j]
                fine = sum(h[c] for h, r in zip(held, rows, strict=True) if r[j] == 2) + pseudo * (1 - first[c][j])
                low[c][j] = bad / (bad + fine)
    model = weak_quality.estimate(codes, rounds=5)
    assert np.allclose(model.shares, shares) and np.allclose(model.table[:, :, 0], low)


def test_the_scorer_steps_down_the_slope():
    rng = np.random.default_rng(1)
    weights, at, value = rng.normal(size=20), np.array([3, 7, 11]), np.array([0.6, -0.3, 0.74])

    def loss(w, b, target):
        p = 1 / (1 + math.exp(-(float(w[at] @ value) + b)))
        return -target * math.log(p) - (1 - target) * math.log(1 - p)

    for target in (0.0, 0.3, 1.0):
        off = weak_quality.slope(weights, 0.2, at, value, target)
        for n, v in zip(at.tolist(), value.tolist(), strict=True):
            moved = weights.copy()
            moved[n] += 1e-6
            assert math.isclose((loss(moved, 0.2, target) - loss(weights, 0.2, target)) / 1e-6, off * v, abs_tol=1e-4)
    rows = [(np.array([0, 2]), np.array([0.8, 0.6])), (np.array([1, 2]), np.array([0.8, 0.6]))] * 30
    scorer = weak_quality.train(rows, np.array([1.0, 0.0] * 30), buckets=4)
    assert scorer.log_odds(*rows[0]) > 1 and scorer.log_odds(*rows[1]) < -1


def test_long_repetitive_texts_are_judged():
    phrase = ["one", "two", "three"]
    name = list(weak_quality.LABELLERS).index("diversity")
    for n in (3999, 4001, 12_000):
        code, _, _ = weak_quality.measure(" ".join((phrase * n)[:n]))
        assert weak_quality.digits(code)[name] == weak_quality.LOW


def bad_text(rng, kind):
    words = prose(rng, 80).split()
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " ".join(w for w in words[:8] for _ in range(12))
    if kind == 2:
        return " ".join(w + rng.choice(["%%%", "$$$", "###"]) for w in words)
    return " | ".join(words)


def test_quality_keeps_the_clean_and_drops_the_rest(documents):
    rng = random.Random(8)
    rows = [(i, bad_text(rng, i % 4) if i % 7 == 0 else prose(rng, rng.randrange(30, 200)).capitalize() + ".") for i in range(700)]
    docs = documents([*rows, (None, "id of nothing"), (1000, None), (1001, ""), (0, "same id")]).withColumn("score", F.lit("clash"))
    model = weak_quality.fit(docs, sample=300)
    scored = {r["doc_id"]: r for r in weak_quality.score_documents(docs, model).collect() if r["doc_id"] not in (0, None)}
    wrong = [i for i, _ in rows if i and scored[i]["kept"] == (i % 7 == 0)]
    assert len(wrong) <= 2
    assert all(0 <= r["score"] <= 1 for r in scored.values()) and len(scored) == 701
    kept = weak_quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {i for i, _ in rows if i % 7 and i not in wrong}
    none = docs.where("false")
    assert weak_quality.score_documents(none, weak_quality.fit(none)).collect() == []


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(300):
        terms = rng.choice(40, rng.integers(1, 9), replace=False)
        w = rng.random(len(terms)) + 0.1
        w /= np.sqrt((w**2).sum())
        vectors.append(dict(zip(terms.tolist(), w.tolist(), strict=True)))
    vectors[10] = dict(vectors[3])  # a tie
    held = [(np.array(sorted(v)), np.array([v[t] for t in sorted(v)])) for v in vectors]
    for block, long_share in ((1, 0.1), (7, 0.2), (64, 0.0), (64, 1.0), (1000, 0.15)):
        index = toxicity.BlockMaxIndex(held, 40, block, long_share)
        for q in (0, 3, 77, 299):
            exact = sorted(((sum(w * v.get(t, 0) for t, w in vectors[q].items()), i) for i, v in enumerate(vectors)), key=lambda x: (-round(x[0], 9), x[1]))
            for k in (1, 5, 50):
                got = index.nearest(held[q], k)
                want = [(c, i) for c, i in exact if c > 0][:k]
                assert [round(c, 9) for c, _ in got] == [round(c, 9) for c, _ in want]
            assert q not in [i for _, i in index.nearest(held[q], 5, skip=q)]


def brute_toxicity(examples, text, k):
    """Cosines of whole TF-IDF vectors against every example, then votes and calibration apart."""
    n, n_toxic = len(examples), sum(y for *_, y in examples)
    counted = [toxicity.terms(t) for _, t, _ in examples]
    rows, toxic = Counter(), Counter()
    for c, (*_, y) in zip(counted, examples, strict=True):
        rows.update(c.keys())
        toxic.update(c.keys() if y else ())

    def weight(t):
        idf, gain = math.log((n + 2) / (rows[t] + 1)), 0.0
        for seen, all_of in ((toxic[t], n_toxic), (rows[t] - toxic[t], n - n_toxic)):
            gain += 2 * seen * math.log(seen * n / (rows[t] * all_of)) if seen else 0.0
        return idf * (1 + math.sqrt(max(gain, 0.0)))

    def unit(c):
        raw = {t: (1 + math.log(m)) * weight(t) for t, m in c.items() if rows[t]}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()}

    q = unit(toxicity.terms(text))
    found = []
    for (i, _, y), c in zip(examples, counted, strict=True):
        e = unit(c)
        cosine = sum(w * e.get(t, 0.0) for t, w in q.items())
        if cosine > 0:
            found.append((cosine, i, y))
    found.sort(key=lambda x: (-round(x[0], 10), x[1]))
    near = found[:k]
    cast = [1 / (1.02 - min(c, 1.0)) for c, _, _ in near]
    return near, (sum(w for w, (*_, y) in zip(cast, near, strict=True) if y) + n_toxic / n) / (sum(cast) + 1)


def test_toxicity_against_brute_force():
    rng = random.Random(9)
    examples = [(i, prose(rng, rng.randrange(3, 60)) + (" grobnak" if i % 5 == 0 else ""), i % 5 == 0) for i in range(120)]
    examples += [(500, "", False), (501, "solitary", True)]
    model = toxicity.fit_examples(examples)
    for text in [prose(rng, n) for n in (1, 4, 30, 400)] + ["grobnak grobnaks marble", "solitary unknown", "The Of " * 50]:
        score, near = model.score(text)
        want, raw = brute_toxicity(examples, text, model.neighbours)
        assert near and [(model.ids[i], bool(model.labels[i])) for _, i in near] == [(i, y) for _, i, y in want]
        assert all(math.isclose(c, w, abs_tol=1e-9) for (c, _), (w, _, _) in zip(near, want, strict=True))
        assert math.isclose(model.vote(near), raw, abs_tol=1e-9)
        assert math.isclose(score, float(np.interp(raw, model.knots, model.values)), abs_tol=1e-9)
    assert model.score("") == (model.bare, []) and model.score("zzz 12") == (model.bare, [])


def test_toxicity_on_held_out_rows(spark, documents):
    rng = random.Random(5)
    insults = ["grobnak", "plimth", "vexwort"]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 9 == 0
        words = prose(rng, rng.randrange(5, 120)).split()
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(insults) + rng.choice(["", "en", "s", ","])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs = documents([*rows, (5000, None), (5001, ""), (None, "grobnak"), (3, "same id")]).withColumn("score", F.lit("clash"))
    table = spark.createDataFrame([*labels, (5000, 1, None), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    held_out = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    learn = table.where(toxicity.learning_rows())
    assert held_out.isdisjoint({r["doc_id"] for r in learn.collect()})
    model = toxicity.fit(docs, learn)
    scored = [r for r in toxicity.score_documents(docs, model).collect()]
    assert len(scored) == 1504 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored)
    test = [r for r in scored if r["doc_id"] in held_out and r["doc_id"] != 3]
    wrong = [r for r in test if r["predicted"] != (r["doc_id"] % 9 == 0)]
    assert len(test) > 250 and len(wrong) <= 2
    hit = next(r for r in test if r["predicted"])
    assert hit["evidence"] and all(e["toxic"] == 1 for e in hit["evidence"]) and math.isclose(hit["evidence"][0]["cosine"], 1, abs_tol=0.9)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] < 0.5 for r in scored)
    nothing = toxicity.fit(docs, table.where("false"))
    assert {r["score"] for r in toxicity.score_documents(docs, nothing).collect()} == {0.0}
    assert toxicity.score_documents(docs.where("false"), model).collect() == []
