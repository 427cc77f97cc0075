"""The corpus pipeline: contract of its stages, and each stage's decisions against brute force."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from nightjar.llm import queries
from tests.llm.test_text_dedup import brute_benchmark, brute_components, brute_lines

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Input and output of every stage over the smallest tables."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = before, docs
    return out


def as_rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_contract(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    for name in names[:-1]:
        before, after = stages[name]
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_quality_stage_keeps_what_the_classifier_accepts(spark, sf, stages):
    before, after = stages["quality_classifier"]
    scores = {r["doc_id"]: r["score"] for r in queries.op10_quality_classifier(spark, sf).collect()}
    assert {r[0] for r in as_rows(after)} == {d for d, s in scores.items() if s >= 0.3}


def test_line_stage(stages):
    before, after = stages["line_dedup"]
    want = Counter((d, t) for (d, t, _, _), n in brute_lines(as_rows(before), 10).items() for _ in range(n))
    assert Counter((r[0], r[1]) for r in as_rows(after)) == want
    assert all(r[4] == len(r[1]) for r in as_rows(after))


def test_simhash_stage(stages):
    before, after = stages["simhash_near_dedup"]
    rows = as_rows(before)
    bag, groups = brute_components(rows, 3, 2)
    assert {r[0] for r in as_rows(after)} == {c for _, _, c in bag} and after.count() == groups


def test_decontamination_stage(spark, sf, stages):
    before, after = stages["benchmark_decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {d for (d, _, hit, _) in brute_benchmark(as_rows(before), items, 10) if not hit}
    assert {r[0] for r in as_rows(after)} == clean


def test_packing_stage_and_run(spark, sf, stages):
    before, after = stages["best_fit_packing"]
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).select(*key).collect())) == Counter(
        map(tuple, after.select(*key).collect()))


def test_an_empty_table_passes_all_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


@pytest.mark.parametrize("copies", [9, 10, 40])
def test_one_whole_document_of_many_copies_stays(spark, sf, copies):
    """Two groups of exact copies and documents with a common line."""
    common = "all rights reserved"
    texts = ["first text of a group\nwith two lines", "quite another matter here\n\nsaid in two parts"]
    rows = [(i * copies + j, t) for i, t in enumerate(texts) for j in range(copies)]
    rows += [(1000 + i, f"{common}\nword{i} {i * 7} only in number {i}") for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                 spark.read.parquet(f"{sf}/documents.parquet").schema)
    lined = corpus_pipeline.lines(spark, docs, sf)
    assert not lined.where(f"text LIKE '%{common}%'").count()
    kept = {r["text"]: r["n_chars"] for r in corpus_pipeline.near_duplicates(spark, lined, sf).collect()}
    assert all(kept[t] == len(t) for t in texts) and "" not in kept


def test_library_works_without_the_subpackage(tmp_path):
    """Without the llm folders and the pipeline, the entry module still imports."""
    for item in ("__spark_entry__.py", "nightjar"):
        (tmp_path / item).symlink_to(ROOT / item)
    (tmp_path / "nightjar").unlink()
    (tmp_path / "nightjar").mkdir()
    for p in (ROOT / "nightjar").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "nightjar" / p.name).symlink_to(p)
    code = ("import os, sys; sys.path.insert(0, '.'); os.path.abspath = lambda p, f=os.path.abspath: f(p);"
            "import __spark_entry__ as e; q = e.queries(); assert e.llm is None and len(q) > 100 and 'pipeline' not in q")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
