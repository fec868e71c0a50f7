import json
import os
import subprocess
import sys

import corpus_pipeline
from rowtide.llm import queries
from rowtide.llm.toxicity import score_documents
from rowtide.llm.weak_quality import fit, score_documents as score_quality
from test_dedup import CLASHES, brute_components, clashing
from test_overlap import shingles

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_against_brute_force(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "exact dedup", "simhash near-dedup", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        out.append(sorted(map(tuple, got.collect()), key=repr))
        docs = spark.createDataFrame(out[-1], docs.schema)
    start = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r["doc_id"]: r["score"] for r in score_documents(start, queries.toxicity_model(spark, start, SF)).collect()}
    assert out[0] == sorted((tuple(r) for r in start.collect() if toxic[r["doc_id"]] < 0.5), key=repr)
    first = spark.createDataFrame(out[0], start.schema)
    good = {r["doc_id"] for r in score_quality(first, fit(first)).collect() if r["kept"]}
    assert out[1] == [r for r in out[0] if r[0] in good]
    last = {}
    for r in out[1]:
        last[r[1]] = max(last.get(r[1], r[0]), r[0])
    assert out[2] == [r for r in out[1] if last[r[1]] == r[0]]
    sets = {r[0]: shingles(r[1]) for r in out[2]}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    part = brute_components(sets, links)
    assert out[3] == [r for r in out[2] if part[r[0]] == r[0]]
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in out[3]}


def test_stages_hand_on_odd_rows_and_all_columns(spark, documents):
    """Nulls, empty and repeated rows, names that clash; and no rows at all."""
    good = "The quick harbour signal turns over every stone, and the meadow answers with a lantern. " * 4
    rows = [(1, good), (1, good), (2, good), (3, None), (4, ""), (None, None), (None, good + "Another end."), (5, good + "A third end of the text."), (5, "Same id, but a text of its own, long enough to be prose.")]
    docs = clashing(documents(rows))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, SF)
        assert left.columns == docs.columns
        got = left.collect()
        assert all(r[c] == f"own {c}" for r in got for c in CLASHES)
        docs = spark.createDataFrame(got, docs.schema)
    texts = [r["text"] or "" for r in got]
    assert len(texts) == len(set(texts)) and rows[-1][1] in texts
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() == len(texts)
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).collect() == []


def test_every_operator_has_one_query():
    for n in range(1, 11):
        assert len([q for q in queries.QUERIES if q.startswith(f"op{n}_")]) == 1


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    """Import the entry module from a copy that lacks this package and the pipeline."""
    import shutil

    shutil.copytree(os.path.join(REPO, "rowtide"), tmp_path / "rowtide", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(REPO, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e, json; print(json.dumps(sorted(e.queries())))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    names = json.loads(said.stdout.splitlines()[-1])
    assert "reverse_plan_newest_first" in names and not [n for n in names if n.startswith("op") and n[2].isdigit()]
