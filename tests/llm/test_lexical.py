from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom.llm import lexical
from tenderloom.llm.queries import OP13_SQL, op13_k2_treap
from tests.compare import differences, duck

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=50):
    """(item, rank, doc, score) by the formula; docs and items are lists of (id, text)."""
    bags = [(i, Counter(terms_of(t))) for i, t in docs if terms_of(t)]
    whole, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in {*items}:
        scores = []
        for doc, bag in bags:
            if doc is None:
                continue
            m = 50 + 50 * sum(bag.values()) * whole // length
            score = sum(
                math.floor(1000 * math.log((2 * whole + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m))
                for t in {*terms_of(text)} if t in bag
            )
            if score > 0:
                scores.append((-score, doc))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_terms_are_found_across_slices(monkeypatch):
    text = "Ünï-code x²y ab_cd 12,3 日本 " * 400 + "z" * 5000
    whole = lexical.term_hashes(text.encode())
    monkeypatch.setattr(lexical, "SLICE", 64)
    assert (lexical.term_hashes(text.encode()) == whole).all() and len(whole) == len(terms_of(text))


def test_treap_holds_every_point_once_under_its_largest():
    rng = np.random.default_rng(5)
    for rows, columns, n in ((1, 1, 1), (300, 5, 700), (40, 200, 3000), (1000, 1000, 900)):
        cells = rng.choice(rows * columns, n, replace=False)
        r, c, v = cells // columns, cells % columns, rng.integers(1, 50, n)
        height = max(1, (max(rows, columns) - 1).bit_length())
        bits = max(1, (rows - 1).bit_length())
        nodes, counts = lexical.treap(r, c, v, height, bits)
        assert len(nodes) == n == counts.sum()
        shard = lexical.Shard(np.arange(columns).tobytes(), b"", b"", nodes.tobytes(), height, bits)
        assert {*zip(shard.row.tolist(), shard.column.tolist(), shard.impact.tolist())} == {*zip(r.tolist(), c.tolist(), v.tolist())}

        def below(node, level, row, column):
            size = 1 << height - level
            assert row <= shard.row[node] < row + size and column <= shard.column[node] < column + size
            total, at = 1, shard.child[node]
            for quadrant in range(4):
                if shard.mask[node] >> quadrant & 1:
                    assert shard.impact[at] <= shard.impact[node]
                    total += below(at, level + 1, row + size // 2 * (quadrant >> 1), column + size // 2 * (quadrant & 1))
                    at += 1
            return total

        assert below(0, 0, 0, 0) == n


@pytest.mark.parametrize("k,least", [(1, 1), (5, 1), (50, 1), (10, 4000)])
def test_descent_finds_the_best_columns_with_whole_scores(k, least):
    rng = np.random.default_rng(k)
    rows, columns, n = 500, 300, 6000
    cells = rng.choice(rows * columns, n, replace=False)
    r, c, v = cells // columns, cells % columns, rng.integers(1, 30, n)
    nodes, _ = lexical.treap(r, c, v, 9, 9)
    shard = lexical.Shard(np.arange(columns).tobytes(), b"", b"", nodes.tobytes(), 9, 9)
    for _ in range(20):
        asked = rng.choice(rows, 40, replace=False)
        weights = rng.integers(1, 9, 40)
        scores = np.zeros(columns, np.int64)
        for row, weight in zip(asked, weights):
            scores[c[r == row]] += weight * v[r == row]
        found, got = shard.best(asked, weights, k, least)
        assert (scores[found] == got).all()
        last = max(least, 1, int(np.sort(scores)[-k]))
        assert {*found.tolist()} >= {*np.flatnonzero(scores >= last).tolist()}


@pytest.mark.parametrize("postings,block", [(lexical.POSTINGS, lexical.BLOCK_TERMS), (40, 12)])
def test_operator_equals_brute_force_in_many_shards_and_blocks(spark, make_docs, monkeypatch, postings, block):
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    random.seed(9)
    vocabulary = [f"w{int(random.expovariate(0.1))}" for _ in range(400)] + ["Été", "日本", "B2"]
    docs = [(i, " ".join(random.choice(vocabulary) for _ in range(random.randint(0, 60)))) for i in range(150)]
    docs += [docs[3], docs[3], (7, "w1 other"), (900, docs[5][1]), (901, None), (902, ""), (903, "?! --"), (None, "w1 w2"), (904, "w3 " * 20000)]
    items = [(i, " ".join(random.choice(vocabulary) for _ in range(12))) for i in range(20)]
    items += [items[0], (50, None), (51, ""), (52, "never seen"), (53, "w1"), (None, "w1 w2")]
    frame = make_docs(*[(i, t, "en", "s") for i, t in docs]).withColumn("term", F.lit(1)).withColumn("ids", F.lit(2)).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("weight", F.lit(1))
    for k in (3, 50):
        assert rows_of(lexical.ranked(frame, asked, k)) == brute(docs, items, k)


def test_items_of_one_id_and_empty_tables(spark, make_docs):
    docs = make_docs((1, "a b", "en", "s"), (2, "b c", "en", "s"), (3, "c", "en", "s"))
    items = spark.createDataFrame([(1, "a"), (1, "c"), (1, "a")], "item_id long, text string")
    assert rows_of(lexical.ranked(docs, items)) == brute([(1, "a b"), (2, "b c"), (3, "c")], [(1, "a"), (1, "c")])
    assert lexical.ranked(docs.limit(0), items).count() == 0
    assert lexical.ranked(docs, items.limit(0)).count() == 0
    assert lexical.ranked(make_docs((None, "a", "en", "s")), items).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert not differences(op13_k2_treap(spark, sf).toPandas(), duck(sf).execute(OP13_SQL).df())
