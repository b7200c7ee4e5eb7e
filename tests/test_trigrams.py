"""Substring search through trigram postings against a scan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tenderloom.operators.trigrams import BUCKETS, TrigramIndex, block_grams, bucket, gram_code, grams, needle_grams, posting_task
from tenderloom.plans import search
from tenderloom.rules import DEFAULT_RULES
from tenderloom.schema import TITLE

WORDS = ["Sistem", "software", "KOMPJUTER", "mirëmbajtje", "ndërtim", "rrugë", "a", "π日本", "x.*y", "100%", "İstanbul", "straße", "\U0001f600ok"]


def tenders_of(make_tenders, n, start=0, seed=1):
    rng = random.Random(seed)
    rows = [
        {TITLE: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 4))) + f" nr {i}", "autoriteti_kontraktues": rng.choice(["Bashkia Tiranë", "Ministria", ""]),
         "kodi_cpv_raw": f"{rng.randrange(10**8):08d}-1", "koha_zhvillimit": f"Muaji {i % 12 + 1}"}
        for i in range(n)
    ]
    return make_tenders(*rows).withColumn("id", F.col("id") + start)


@pytest.fixture
def indexed(spark, make_tenders, tmp_path):
    first, second = tenders_of(make_tenders, 400), tenders_of(make_tenders, 150, start=395, seed=2)
    index = search.tender_index(spark, str(tmp_path / "index"), block_rows=8, folder_blocks=4)
    index.append(first)
    index.append(second)  # its first rows share a block with the last ones before
    return first.unionByName(second), index


def test_trigrams_of_texts_and_needles(values):
    texts = ["aBc", "ab", "", None, "aaaa", "ÀBC d", "日本語x", "\U0001f600ok"]
    found = values(grams, texts)
    for text, got in zip(texts, found):
        assert {*needle_grams(text or "")} <= {*got} and (len(text or "") >= 3 or not got)


def test_postings_hold_each_trigram_of_a_block_once_as_a_number(spark):
    rng = random.Random(5)
    rows = [(i // 8, *(rng.choice([None, "", "ab", "aBc", "aaaa", " ".join(rng.choices(WORDS, k=6))]) for _ in "xy")) for i in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "block long, x string, y string").coalesce(1)
    want = {(r[0], f, gram_code(g)) for r in rows for f, t in zip("xy", r[1:]) for g in needle_grams(t or "")}
    found = block_grams(df, ("x", "y"))
    assert found.schema["gram"].dataType.typeName() == "long"
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


@pytest.mark.parametrize(
    "texts",
    [{"q": "SISTEM"}, {"q": "pjut"}, {"q": "ë"}, {"q": "a"}, {"q": "nr 39"}, {"q": "x.*y"}, {"q": "00%"}, {"q": "日本"}, {"q": "π日本"}, {"q": "never there"}, {"q": "  ware "},
     {"q": "\U0001f600ok"}, {"q": "stanbul"}, {"authority": "TIRAN", "q": "soft"}, {"cpv": "12", "koha_zhvillimit": "MUAJI 1"}, {"cpv": "123"}, {"q": " ", "cpv": ""}],
)
def test_rows_equal_the_scan(indexed, texts):
    tenders, index = indexed
    want = sorted((r["id"], r[TITLE]) for r in search.matching(tenders, **texts).collect())
    found = search.matching(index, **texts)
    assert found.columns == tenders.columns
    assert sorted((r["id"], r[TITLE]) for r in found.collect()) == want


def test_files_read_shrink_with_the_needle(indexed):
    _, index = indexed
    every = len(index.rows().inputFiles())

    near = index.candidates([("nr 217", (TITLE,))])
    plan = near._jdf.queryExecution().sparkPlan().toString()
    assert "PartitionFilters" in plan
    read = [f for f in index.rows().inputFiles() if f"folder={217 // 32}/" in f]
    assert 1 <= len(read) < every / 5  # ids 0 to 31 are folder 0 and so on
    one = index.blocks("nr 217", (TITLE,))
    assert 1 <= one.count() <= 4
    rows = index.candidates([("nr 217", (TITLE,))]).count()
    assert 0 < rows < 80 and every > 10
    assert index.candidates([("zzz", (TITLE,))]).count() == 0
    assert index.candidates([("ab", (TITLE,))]).count() == index.rows().count()


def test_pages_over_an_index_equal_pages_over_the_table(indexed):
    tenders, index = indexed
    want = search.search_page(tenders, q="soft", page=2, page_size=7)
    found = search.search_page(index, q="soft", page=2, page_size=7)
    assert [r["id"] for r in found.items.collect()] == [r["id"] for r in want.items.collect()]
    assert found.totals.first() == want.totals.first()
    deep = search.search_pages(index, q="soft").page(2, 7)
    assert sorted(r["id"] for r in deep.collect()) == sorted(r["id"] for r in want.items.collect())
    with pytest.raises(TypeError, match="unknown text filters"):
        search.matching(index, title="x", rules=DEFAULT_RULES)


def test_postings_are_dealt_evenly_and_texts_are_read_once_for_each_table(spark, make_tenders, tmp_path):
    keys = spark.range(64000).select(F.lit("f").alias("field"), F.col("id").alias("gram"))
    keys = keys.withColumn("bucket", bucket(F.col("field"), F.col("gram")))
    for tasks in (1, 8, 200):
        dealt = keys.withColumn("task", posting_task(F.col("bucket"), F.col("field"), F.col("gram"), tasks))
        per = dealt.groupBy("task").agg(F.count("*").alias("n"), F.min("bucket").alias("low"), F.max("bucket").alias("high")).orderBy("task").collect()
        assert [r["task"] for r in per] == list(range(tasks))
        assert max(r["n"] for r in per) < 1.3 * 64000 / tasks
        assert all(a["high"] <= b["low"] for a, b in zip(per, per[1:])) and {per[0]["low"], per[-1]["high"]} == {0, BUCKETS - 1}
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    tenders = tenders_of(make_tenders, 100)
    search.tender_index(spark, str(tmp_path / "once")).append(tenders.mapInArrow(counted, tenders.schema))
    assert read.value == 200  # once for the rows, once for the postings


def test_an_index_without_rows(spark, make_tenders, tmp_path):
    index = TrigramIndex(spark, str(tmp_path / "empty"), (TITLE,))
    index.append(tenders_of(make_tenders, 3).filter("id < 0"))
    assert index.candidates([("abc", (TITLE,))]).count() == 0
