"""Stages of the corpus pipeline, each against a plain reading of what it keeps."""

import re

import pytest

import corpus_pipeline
from docloom.llm import exact_dedup, secret_scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    from docloom.scratch import stage

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        new = stage(f(spark, docs, SF), "test")
        out.append((name, docs, new))
        docs = new
    return out


def test_columns(steps):
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns


def test_rows(steps):
    got = [({r.doc_id: r.text for r in a.collect()}, {r.doc_id: r.text for r in b.collect()}) for _, a, b in steps[:-1]]
    before, after = got[1]
    first: dict[str, int] = {}
    for d in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[d] or ""), d)
    assert set(after) == set(first.values())
    before, after = got[2]
    from tests.llm.test_brute import jaccard_components

    assert set(after) == {d for d, (_, c) in jaccard_components(before, 5, 80).items() if d == c}
    before, after = got[3]
    assert set(before) == set(after)
    assert all((before[d] == after[d]) == (not secret_scan.base_spans(before[d])) or secret_scan.novel_spans(before[d], []) for d in before)


def test_packing_covers_all(steps):
    _, docs, pieces = steps[-1]
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_on_edges(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, copies, columns whose names the stages use, and empty tables."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))
    rows = [(1, "Same  text here"), (2, "Same text\there"), (None, "Same text here"), (3, None), (4, ""), (5, long), (6, long + " end"), (7, "one"), (7, "one"), (None, "no id")]
    names = ["toxic_score", "_toxic", "_key", "copy_key", "COPY_KEY_", "text_sha256", "component_id", "kept"]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), *[9.0] * len(names)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` double" for n in names)).repartition(3)
    left = {"toxicity": 10, "exact dedup": 6, "n-gram Jaccard join": 5, "secret scans": 5}
    for table in (docs, docs.limit(0)):
        got = table
        for name, step in corpus_pipeline.STAGES[:-1]:
            got = spark.createDataFrame(step(spark, got, SF).collect(), table.schema)
            assert got.columns == docs.columns
            assert got.count() == (left[name] if table is docs else 0), name
        assert got.filter(" or ".join(f"`{n}` <> 9.0" for n in names)).count() == 0
        pieces = corpus_pipeline.STAGES[-1][1](spark, got, SF).collect()
        assert sorted({r.doc_id for r in pieces}, key=str) == ([1, 3, 5, 7, None] if table is docs else [])


def test_recipes_or_whole_texts(spark, monkeypatch):
    """If two chunks share an identifier, texts themselves are compared, with the same result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    with_recipes = sorted(map(tuple, exact_dedup.group_exact(docs).drop("row_id").collect()))
    monkeypatch.setattr(exact_dedup, "chunks_verified", lambda _: False)
    assert sorted(map(tuple, exact_dedup.group_exact(docs).drop("row_id").collect())) == with_recipes
