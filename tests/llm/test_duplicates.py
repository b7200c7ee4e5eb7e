from __future__ import annotations

import random
import time

import numpy as np
import pytest

from tenderloom.llm import chaining, common, hyperminhash, queries, suffixes
from tenderloom.llm.common import minimisers, word_hashes
from tenderloom.llm.components import components


def _components(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components_of_paths_stars_and_copies(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 4000), (4000, 5000), (7, 7)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = _components({x for e in edges if e[0] != e[1] for x in e}, edges)
    assert found == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _near_texts(seed: int, words: int = 120):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [random.choice(vocabulary) for _ in range(words)]
    texts = [" ".join(base)]
    for edits in (1, 1, 2, 3, 4, 5, 8, 20):
        own = list(base)
        for _ in range(edits):
            own[random.randrange(words)] = random.choice(vocabulary)
        texts.append(" ".join(own).replace("w1", "W1"))
    return texts + [" ".join(random.choice(vocabulary) for _ in range(words))]


def _shingles(text, k):
    words = text.encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if len(words) >= k else {tuple(words)}


def test_near_duplicates_equal_brute_force(make_docs):
    rows = [(i, t, "en", "s") for i, t in enumerate(t for seed in range(6) for t in _near_texts(seed, 40 + 30 * seed))]
    rows += [(900, None, None, None), (901, "", "en", "s"), (902, " \t ", "en", "s"), (903, "one two", "en", "s"), (904, "One\ttwo", "en", "s"), (905, "one", "en", "s")]
    rows += [(906, rows[3][1], "en", "s"), (906, rows[3][1], "en", "s"), (None, rows[3][1], "en", "s"), (907, "long word " * 30000, "en", "s")]
    for k, percent in ((3, 85), (5, 80)):
        sets = {i: _shingles(t or "", k) for i, t, _, _ in rows if i is not None}
        ids = sorted(sets)
        links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        expected = _components(ids, links)
        found = hyperminhash.near_duplicates(make_docs(*rows), shingle=k, threshold=percent / 100).collect()
        assert len(found) == len(rows)
        for r in found:
            if r["doc_id"] is None:
                assert r["component_id"] is None and not r["kept"]
            else:
                assert r["component_id"] == expected[r["doc_id"]]
                assert r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"])
    assert hyperminhash.near_duplicates(make_docs(*rows).limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, 15])
def test_clusters_of_many_blocks_lose_no_link(make_docs, monkeypatch, block):
    monkeypatch.setattr(hyperminhash, "BLOCK", block)
    random.seed(block)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [random.choice(vocabulary) for _ in range(150)]
    rows, text = [], list(base)
    for i in range(70):  # a chain: neighbours are linked, ends are far apart
        text[random.randrange(150)] = random.choice(vocabulary)
        if i % 2:
            text[random.randrange(150)] = random.choice(vocabulary)
        rows.append((1000 - i if i % 3 else i, " ".join(text), "en", "s"))
    for i in range(60):  # around one text, most of them near the threshold
        own = list(base)
        for _ in range(random.choice([1, 5, 7, 8, 9])):
            own[random.randrange(150)] = random.choice(vocabulary)
        rows.append((2000 + i, " ".join(own), "en", "s"))
    sets = {i: _shingles(t, 3) for i, t, _, _ in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    expected = _components(ids, links)
    assert len(set(expected.values())) > 5
    found = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(make_docs(*rows), shingle=3, threshold=0.85).collect()}
    assert found == expected


def test_expected_collisions_depend_on_both_sizes():
    rng = np.random.default_rng(11)
    for n, m in ((300, 300), (5000, 5000), (300, 20000), (100000, 100000)):
        a, b = (np.stack([hyperminhash.sketch(rng.integers(0, 2**63, size).astype(np.uint64)) for _ in range(60)]) for size in (n, m))
        assert abs((a == b).mean() - hyperminhash.expected_collisions(np.array([n]), np.array([m]))[0, 0]) < 0.006


def test_hyperminhash_estimates_follow_jaccard():
    rng = np.random.default_rng(4)
    for similarity in (0.3, 0.6, 0.85, 1.0):
        errors = []
        for _ in range(40):
            pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
            both = int(round(2000 * 2 * similarity / (1 + similarity)))
            a, b = pool[:2000], np.concatenate([pool[:both], pool[2000 : 4000 - both]])
            true = both / (4000 - both)
            errors.append(hyperminhash.estimate(hyperminhash.sketch(a)[None], hyperminhash.sketch(b)[None], np.array([len(a)]), np.array([len(b)]))[0, 0] - true)
        assert abs(np.mean(errors)) < 0.03
    one = hyperminhash.sketch(np.array([5], np.uint64))
    assert len(set(one.tolist())) == 1  # a single element fills every register


def test_minimisers_hold_every_window():
    rng = np.random.default_rng(2)
    for values in (rng.integers(0, 2**62, 200), np.tile(rng.integers(0, 2**62, 7), 30), np.ones(90, np.int64)):
        values = values.astype(np.uint64)
        assert minimisers(values, 26).tolist() == sorted({i + int(np.argmin(values[i : i + 26])) for i in range(len(values) - 25)})


def _planted():
    random.seed(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    fill = lambda n: [random.choice(vocabulary) for _ in range(n)]
    passage, other = fill(60), fill(52)
    texts = [fill(80) + passage + fill(30), fill(20) + passage + fill(10) + other, other + fill(40), fill(200), fill(45), passage[:49] + fill(60)]
    texts += [list(texts[0]), [w.upper() for w in texts[3]]]
    fuzzy = list(passage)
    fuzzy[20], fuzzy[40] = "changed", "words"
    texts.append(fill(33) + fuzzy + fill(25))
    return [" ".join(t) for t in texts]


def _windows(texts, n):
    holders = {}
    for i, t in enumerate(texts):
        words = word_hashes(t.encode()).tolist()
        for at in range(len(words) - n + 1):
            holders.setdefault(tuple(words[at : at + n]), set()).add((i, at))
    covered = {}
    for places in holders.values():
        if len({i for i, _ in places}) > 1:
            for i, at in places:
                covered.setdefault(i, set()).update(range(at, at + n))
    return covered


def test_repeated_passages_equal_brute_force(make_docs):
    texts = _planted() + ["a b " * 100, "a b " * 60 + "c", "x " * 70]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, texts[0], "en", "s"), (100, None, None, None), (101, "", "en", "s")]
    found = {}
    for r in suffixes.repeated_passages(make_docs(*rows)).collect():
        found.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert found == _windows(texts, 50)
    assert suffixes.repeated_passages(make_docs(*rows).limit(0)).count() == 0


def test_fuzzy_passages_find_planted_ones(make_docs):
    texts = _planted()
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, texts[0], "en", "s"), (100, None, None, None), (101, "", "en", "s")]
    found = chaining.fuzzy_passages(make_docs(*rows)).collect()
    pairs = {(r["doc_id"], r["ref_id"]) for r in found}
    assert {(1, 0), (2, 1), (6, 0), (7, 3), (8, 0)} <= pairs
    assert not {4} & {x for p in pairs for x in p}
    fuzzy = next(r for r in found if r["doc_id"] == 8)
    assert 33 <= fuzzy["start_word"] <= 38 and 88 <= fuzzy["end_word"] <= 93 and 0.9 < fuzzy["similarity"] < 1
    assert chaining.fuzzy_passages(make_docs(*rows).limit(0)).count() == 0


def _edited(rng, passage, at):
    own = list(passage)
    for i in at:
        own[i] = f"edit{rng.randrange(10**6)}"
    return own


def test_fuzzy_passages_with_edits_near_the_ends(make_docs):
    rng = random.Random(11)
    fill = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    rows, expected = [], {}
    for n in range(40):
        length = 55 if n < 10 else 50 + n % 31
        passage = fill(length)
        at = (4, 50) if n < 10 else range(3 + n % 4, length - 2, 8 + n % 3)
        edited = _edited(rng, passage, at)
        rows += [(2 * n, " ".join(fill(30) + passage + fill(30)), "en", "s"), (2 * n + 1, " ".join(fill(40) + edited + fill(20)), "en", "s")]
        expected[2 * n + 1] = (2 * n, 40, 40 + length, 1 - len(at) / length)
    found = {r["doc_id"]: r for r in chaining.fuzzy_passages(make_docs(*rows)).collect()}
    assert set(found) == set(expected)
    for doc, (ref, start, end, same) in expected.items():
        r = found[doc]
        assert r["ref_id"] == ref and start <= r["start_word"] <= start + 7 and end - 7 <= r["end_word"] <= end
        assert r["end_word"] - r["start_word"] >= 50 and r["similarity"] >= 0.8 and abs(r["similarity"] - same) < 0.06


@pytest.mark.parametrize("pieces", ["below", "between"])
def test_fuzzy_passages_whose_pieces_stand_in_other_documents(make_docs, pieces):
    rng = random.Random(13)
    fill = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    rows, expected = [], set()
    for n in range(20):
        passage = fill(60)
        low, high, piece = (1000 * n + 500, 1000 * n + 900, 1000 * n + (1 if pieces == "below" else 600))
        rows += [(low, " ".join(fill(30) + passage + fill(30)), "en", "s"), (high, " ".join(fill(20) + _edited(rng, passage, range(4, 58, 9)) + fill(40)), "en", "s")]
        rows += [(piece + i, " ".join(fill(40) + passage[8 * i : 8 * i + 8] + fill(40)), "en", "s") for i in range(7)]
        expected.add((high, low))
    found = {(r["doc_id"], r["ref_id"]) for r in chaining.fuzzy_passages(make_docs(*rows)).collect()}
    assert found == expected


def _scattered(rng, groups=12):
    """Pairs (high, low) of edited passages whose pieces stand in smaller ids and in ids between both as well."""
    fill = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    rows, expected = [], set()
    for n in range(groups):
        passage = fill(60)
        low, high = 1000 * n + 500, 1000 * n + 900
        rows += [(low, " ".join(fill(30) + passage + fill(30)), "en", "s"), (high, " ".join(fill(20) + _edited(rng, passage, range(4, 58, 9)) + fill(40)), "en", "s")]
        rows += [(1000 * n + at + i, " ".join(fill(40) + passage[8 * i : 8 * i + 8] + fill(40)), "en", "s") for at in (1, 600) for i in range(7)]
        expected.add((high, low))
    return rows, expected


@pytest.mark.parametrize("block", [1024, 2])
def test_fuzzy_passages_whose_seeds_all_have_holders_below_and_between(make_docs, monkeypatch, block):
    monkeypatch.setattr(chaining, "BLOCK", block)
    rows, expected = _scattered(random.Random(19))
    found = {(r["doc_id"], r["ref_id"]) for r in chaining.fuzzy_passages(make_docs(*rows)).collect()}
    assert found == expected


def test_passage_classes_equal_those_of_all_pairs(make_docs):
    rng = random.Random(23)
    fill = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    rows, expected = _scattered(rng, 4)
    passage = fill(60)
    rows += [(5000 + i, " ".join(fill(10 + i) + passage + fill(20)), "en", "s") for i in range(5)]
    rows += [(5100, rows[-1][1], "en", "s"), (5200, None, "en", "s"), (None, rows[-1][1], "en", "s")]
    classes = {r["doc_id"]: r["class_id"] for r in chaining.passage_classes(make_docs(*rows)).collect()}
    want = {r[0]: r[0] for r in rows if r[0] is not None} | dict(expected) | {5000 + i: 5000 for i in range(5)} | {5100: 5000}
    assert classes == want


def test_keys_keep_the_rarest_seed_of_every_chain():
    rng = np.random.default_rng(29)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        counts, at, sizes = rng.integers(2, 6, n), np.sort(rng.choice(60, n, replace=False)), rng.choice([5, 25], n, p=[0.9, 0.1])
        plain = [
            sizes[i] > 5 or ((counts >= counts[i]).sum() >= 3 and np.ptp(at[counts >= counts[i]]) >= 20)
            for i in range(n)
        ]
        assert chaining.keys_of(counts, at, sizes, 20).tolist() == plain


def test_repeated_ids_and_copies_in_seed_matching(make_docs, monkeypatch):
    rng = random.Random(17)
    fill = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    passage = fill(60)
    own = [" ".join(fill(10 + i) + passage + fill(20)) for i in range(6)]
    rows = [(i + 1, t, "en", "s") for i, t in enumerate(own)] + [(9, own[0], "en", "s"), (9, own[0], "en", "s"), (7, None, "en", "s"), (None, own[1], "en", "s")]
    found = {(r["doc_id"], r["ref_id"]) for r in chaining.fuzzy_passages(make_docs(*rows)).collect()}
    assert found == {(d, 1) for d in range(2, 7)} | {(d, d - 1) for d in range(3, 7)} | {(9, 1)}


def test_edit_distance_and_chains_equal_brute_force():
    rng = random.Random(6)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        assert chaining.edit_distance(np.array(a, np.uint64), np.array(b, np.uint64)) == plain(a, b)
    for _ in range(100):
        matches = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(12)})
        best = {}
        for x, y in matches:
            gains = [best[(p, q)] - 0.1 * (x + y - p - q - 10) for p, q in best if p < x and q < y]
            best[(x, y)] = 5 + max([0.0, *(g - 0.0 for g in gains)])
        assert abs(chaining.chains(matches)[0][0] - max(best.values())) < 1e-9


def test_op9_gives_passages_and_classes(spark, make_docs, tmp_path):
    rng = random.Random(31)
    fill = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    passage, other = fill(60), fill(60)
    texts = {1: fill(30) + passage + fill(20), 2: fill(10) + passage + other, 3: other + fill(40), 4: fill(90), 5: fill(20)}
    rows = [(i, " ".join(t), "en", "s") for i, t in texts.items()] + [(6, " ".join(texts[4]), "en", "s"), (7, None, "en", "s"), (None, "x", "en", "s")]
    make_docs(*rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op9_chaining(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["class_id"], r["kept"]) for r in found} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (6, 4, False), (7, 7, True)}
    spans = {(r["doc_id"], r["start_word"], r["end_word"], r["ref_id"], r["ref_start"], r["ref_end"], r["similarity"]) for r in found if r["ref_id"] is not None}
    assert spans == {(2, 10, 70, 1, 30, 90, 1.0), (3, 0, 60, 2, 70, 130, 1.0), (6, 0, 90, 4, 0, 90, 1.0)}


@pytest.mark.parametrize("block", [1024, 2])
def test_passages_of_frequent_seeds_alone(make_docs, monkeypatch, block):
    monkeypatch.setattr(chaining, "BLOCK", block)
    monkeypatch.setattr(chaining, "RARE", 1)
    rows, expected = _scattered(random.Random(37))
    found = {(r["doc_id"], r["ref_id"]) for r in chaining.fuzzy_passages(make_docs(*rows)).collect()}
    assert found == expected


def test_lines_far_apart_make_no_pairs(make_docs, monkeypatch):
    rng = random.Random(41)
    fill = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    first, second = fill(12), fill(12)
    rows = [(i, " ".join(fill(20 + i) + first + fill(300 + 7 * i) + second + fill(30)), "en", "s") for i in range(40)]
    met, matches = [], chaining._pair_matches
    monkeypatch.setattr(chaining, "_pair_matches", lambda pairs, *rest: (met.append(pairs.count()), matches(pairs, *rest))[1])
    assert chaining.fuzzy_passages(make_docs(*rows)).count() == 0
    assert sum(met) < 40  # 780 pairs hold both lines


def test_pair_keys_equal_brute_force():
    rng = np.random.default_rng(43)
    for n in (0, 1, 2, 40, 300):
        at = np.sort(rng.choice(40 + 6 * n, n, replace=False)).astype(np.int64)
        gram = rng.integers(0, max(1, n // 2) + 1, n).astype(np.int64)
        reach = chaining.reaches(at)
        found = set(chaining.pair_keys(gram, at, reach, 20).tolist())
        score = []
        for i in range(n):
            score.append(5 + max([0.0, *(score[j] - 0.15 * (at[i] - at[j]) + 1 for j in range(i))]))
        assert np.array_equal(reach, np.ceil((np.array(score) + 1) / 0.15 - 1e-9).astype(np.int64)) or np.abs(reach - (np.array(score) + 1) / 0.15).max() <= 1.01
        key = lambda i, j: int((chaining.mixed(gram[i : i + 1].view(np.uint64)) + gram[j : j + 1].view(np.uint64)).view(np.int64)[0])
        must = {key(i, j) for i in range(n) for j in range(n) if 20 <= at[j] - at[i] <= reach[i]}
        assert must <= found
        assert found <= {key(i, j) for i in range(n) for j in range(n) if at[j] - at[i] > 20 - 2 * chaining.THIN}


def test_stored_tables_leave_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in _scala(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle")}
    before, setting = files(), spark.conf.get(common.CLEAN, None)
    assert common.stored(spark.range(1000).repartition(4, "id").groupBy("id").count(), "test").count() == 1000
    for _ in range(50):
        # the count has an exchange of one row a task
        left = files() - before
        if len({f.split("_")[1] for f in left}) <= 1:
            break
        time.sleep(0.1)
    assert len({f.split("_")[1] for f in left}) <= 1 and spark.conf.get(common.CLEAN, None) == setting


def _scala(items):
    return [items.apply(i) for i in range(items.size())]


def test_syncmers_equal_plain_choice():
    rng = np.random.default_rng(47)
    for words in (rng.integers(0, 2**62, 200), np.tile(rng.integers(0, 2**62, 3), 30), np.ones(60, np.int64), np.arange(4), np.arange(5)):
        words = words.astype(np.uint64)
        inner = common.gram_hashes(words, 2)
        plain = [i for i in range(len(words) - 4) if int(np.argmin(inner[i : i + 4])) in (0, 3)]
        assert common.syncmers(words, 5).tolist() == plain


def test_unrelated_documents_share_no_band(spark, make_docs):
    rng = np.random.default_rng(59)
    rows = [(i, " ".join(f"u{x}" for x in rng.integers(0, 10**9, 3 + i % 9)), "en", "s") for i in range(3000)]
    heads = hyperminhash.profiles(make_docs(*rows), "doc_id", "text", 5, 0.8)
    assert hyperminhash.clusters(heads).count() == 0


def test_equal_minima_have_equal_registers():
    rng = np.random.default_rng(61)
    for n in (1, 3, 40, 500, 20000):
        shingles = rng.integers(0, 2**63, n).astype(np.uint64)
        part = np.concatenate([shingles, rng.integers(0, 2**63, 1 + n // 10).astype(np.uint64)])
        low, other = hyperminhash.minima(shingles), hyperminhash.minima(part)
        same = low == other
        assert same.any() and (hyperminhash.sketch(shingles) == hyperminhash.sketch(part))[same].all()
        assert abs(same.mean() - n / len(part)) < 0.3
