from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import functions as F

from tenderloom.llm import langid

SF = "/root/testdata/sf0.01"


def _plain(text: str, length: int) -> list[str]:
    """The ranked n-grams by plain string handling."""
    line = "".join(c if c.isalpha() else " " for c in text.lower())
    line = " " + " ".join(line.split()) + " "
    grams = Counter()
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            gram = line[i : i + n]
            if n == 1 and gram == " " or n == 3 and gram[1] == " ":
                continue
            grams[gram] += 1
    return grams


def test_profile_counts_are_those_of_plain_strings():
    text = "Thé quick, brown fox! the 123 quick"
    codes = langid._grams(text)
    assert len(codes) == sum(_plain(text, 0).values())
    assert sorted(Counter(codes.tolist()).values()) == sorted(_plain(text, 0).values())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.language_of(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.97
    assert found["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(found["doc_id"], found["held_out"]))


def test_labels_and_sources_are_no_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = langid.fit(docs, ~langid.held_out()).cache()
    plain = langid.identify(docs.select("doc_id", "text"), profiles)
    turned = langid.identify(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), profiles)
    assert plain.select("doc_id", "lang_pred").exceptAll(turned.select("doc_id", "lang_pred")).count() == 0


def test_odd_rows(make_docs):
    docs = make_docs((1, "the cat and the dog", "en", "s"), (2, "der hund und die katze", "de", "s"), (3, None, "en", None), (4, "", None, "s"),
                     (5, "123 !!", "en", "s"), (None, "the dog", None, "s"), (1, "the cat and the dog", "en", "s"), (7, "the " * 50000, None, "s"))
    out = {(r["doc_id"], r["lang_pred"]) for r in langid.language_of(docs).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (1, "en"), (7, "en")} <= out
    assert langid.language_of(docs).count() == 8
    kept = langid.with_language(docs)
    assert kept.columns == docs.columns and kept.count() == 5
    assert langid.language_of(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.language_of(unlabelled).collect()} == {"und"}


def test_stage_without_labels_and_with_null_ones(make_docs):
    text = "the quick brown fox jumps over the lazy dog"
    bare = make_docs((1, text, None, "s"), (2, "12 - 34", None, "s"), (3, None, None, "s"))
    assert [(r["doc_id"], r["lang"]) for r in langid.with_language(bare).collect()] == [(1, None)]
    out = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1][:2]
    german = "der schnelle braune fuchs springt über den faulen hund"
    docs = make_docs((out[0], text, "en", "s"), (out[1], german, "de", "s"), (200, text, None, "s"), (201, german, None, "s"), (202, "Ωμέγα", None, "s"))
    found = {r["doc_id"]: r["lang"] for r in langid.with_language(docs).collect()}
    assert found == {out[0]: "en", out[1]: "de", 200: "en", 201: "de", 202: None}
