from __future__ import annotations

import re

import corpus_pipeline as pipeline
from tenderloom.llm import hyperminhash, langid, pii, raking
from tests.llm.test_duplicates import _components, _shingles

SF = "/root/testdata/sf0.001"


def test_run_equals_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    lettered = {i for i, r in rows.items() if r["text"] and any(map(str.isalpha, r["text"]))}
    sets = {i: _shingles(rows[i]["text"], 5) for i in lettered}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = _components(sets, links)
    unique = {i for i in sets if label[i] == i}
    result = pipeline.run(spark, SF).collect()
    found = {r["doc_id"] for r in result}
    assert found <= unique and 0.2 * len(unique) < len(found) < len(unique)
    kept = pipeline.near_dedup(spark, pipeline.language(spark, docs, SF), SF)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == unique
    assert kept.columns == docs.columns
    private = pipeline.private(spark, kept, SF)
    assert private.columns == docs.columns
    pattern = re.compile(r"\S+@\S+\.\w+|AKIA[A-Z0-9]{16}|\+1 \(\d{3}\) \d{3}-\d{4}")
    before = {m for i in unique for m in pattern.findall(rows[i]["text"])}
    texts = {r["doc_id"]: r for r in private.collect()}
    assert not {m for r in texts.values() for m in pattern.findall(r["text"])} & before
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values())


def test_stages_take_odd_rows(spark, make_docs):
    docs = make_docs((1, None, None, None), (None, "some words here", "en", "s"), (2, "", "en", "s"), (3, "a b c d e f", "en", "s"), (3, "a b c d e f", "en", "s"))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()
        stage(spark, docs.limit(0), SF).collect()
    assert pipeline.tokens(spark, docs, SF).count() == docs.count()


def test_operators_are_the_dealt_ones():
    assert [f.__name__ for _, f in pipeline.STAGES] == ["language", "near_dedup", "private", "mixture", "tokens"]
    assert {langid, hyperminhash, pii, raking} <= {v for v in vars(pipeline).values() if hasattr(v, "__file__")}
