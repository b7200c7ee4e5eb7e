from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tenderloom.llm import variants
from tenderloom.llm.queries import OP12_SQL, op12_spelling_variants
from tests.compare import differences, duck

UPPER, LOWER = variants.UPPER, variants.LOWER


def brute(texts, slip=31):
    """The contract word by word: texts are (id, text)."""
    counts = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % slip == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def rows_of(frame):
    found = frame.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found}
    assert len(out) == len(found)
    return out


def test_tiles_find_every_single_edit_of_a_group_once():
    random.seed(2)
    words = sorted({"".join(random.choice("abé") for _ in range(random.choice([7, 8]))) for _ in range(900)})
    n = len(words)
    zero = np.zeros(n, np.int64)
    found = Counter()
    for longer in (8,):
        for low, high in ((0, 3), (3, 5), (5, 8)):
            i, j = variants.near_pairs(words, zero, zero + longer, zero + low, zero + high)
            found.update(zip(i.tolist(), j.tolist()))
    expected = {(i, j) for i in range(n) for j in range(i + 1, n) if one_edit(words[i], words[j]) and max(len(words[i]), len(words[j])) == 8}
    assert set(found) == expected and set(found.values()) == {1}


@pytest.mark.parametrize("most", [2, 20, 192])
def test_operator_equals_brute_force_also_with_halved_segments(spark, make_docs, most, monkeypatch):
    random.seed(6)
    stems = ["".join(random.choice("abcé") for _ in range(random.randint(7, 11))) for _ in range(25)] + ["aaaaaaaa", "zusammenhang"]
    def varied(w):
        kind, at = random.random(), random.randrange(len(w))
        return w if kind < 0.5 else w[:at] + random.choice("abxÿ") + w[at + (kind < 0.7) :] if kind < 0.85 else w[:at] + w[at + 1 :]
    texts = [(i, " ".join(random.choice([str.upper, str])(varied(random.choice(stems))) for _ in range(60)) + " frequent" * 40) for i in range(60)]
    texts += [(60, "frequend frequend 'frequent'd Frequentfrequent")] * 2
    monkeypatch.setattr(variants.bounded_groups, "__defaults__", (most,))
    found = rows_of(variants.spelling_variants(make_docs(*[(i, t, "de", "s") for i, t in texts])))
    assert found == brute(texts)
    assert found["frequend"][:2] == ("frequent", "frequent")


def test_forms_are_followed_to_the_last(spark, make_docs):
    words = {"wordone": 2, "wordtone": 30, "wordtonne": 400}
    texts = [(1, " ".join(w for w, n in words.items() for _ in range(n)))]
    found = rows_of(variants.spelling_variants(make_docs((1, texts[0][1], "en", "s")), slip=2**32))
    assert found["wordone"] == ("wordtone", "wordtonne", 2, 1, 30)
    assert found == brute(texts, slip=2**33)


def test_odd_rows(spark, make_docs):
    long = "a" * 30000
    texts = [(None, "nullable nullable"), (1, None), (1, None), (2, ""), (3, "x" * 6), (4, f"{long} {long} {long}b {long}b"), (5, "naïvement naivement naivement naïvement"), (5, "naïvement")]
    frame = make_docs(*[(i, t, "en", "s") for i, t in texts]).withColumn("word", variants.F.lit("w")).withColumn("n", variants.F.lit(1))
    found = rows_of(variants.spelling_variants(frame))
    assert found == brute(texts)
    assert variants.spelling_variants(make_docs((1, "short", "en", "s"))).count() == 0
    assert variants.spelling_variants(frame.limit(0)).count() == 0


def test_query_equals_sql_and_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    result = op12_spelling_variants(spark, sf)
    assert not differences(result.toPandas(), duck(sf).execute(OP12_SQL).df())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(result) == brute([tuple(r) for r in docs])
