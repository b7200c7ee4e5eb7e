from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

from tenderloom.llm import packing  # noqa: E402
from tenderloom.llm.packing import Example, Limits, Packer  # noqa: E402
from tenderloom.llm.queries import op11_vector_packing, word_bpe_path  # noqa: E402

ODD = [
    "", " ", "It's  we'll 'S don't", "x<|endoftext|> <|startoftext|>y <|endoftext|>", "Été ΩΣΑΣ é ́b İstanbul", "日本語テキスト ☃️ 👩‍👩‍👧 ١٢٣ ½²",
    "a\x1cb\x85c\xa0d　e", "tab\tnew\nline\x0bform\x0cend\r\n", "..." * 700, "ab" * 4000,
    "Word. word, WORD; x.. y., z.a 'S, b's. <|STARTOFTEXT|> <|endoftext|>. J\u030c T\u0308. A\u030a, 1. 2!? ab?",
]


@pytest.fixture(scope="module")
def library():
    own = tokenizers.Tokenizer.from_file(word_bpe_path())
    own.no_truncation()
    own.no_padding()
    return own


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@pytest.mark.parametrize("remembered", [3, 1000])
def test_words_give_the_ids_of_whole_texts(library, remembered):
    random.seed(4)
    letters = "aeiou tnsrhldTHE'.,12 \n\xa0éèü日"
    texts = ODD + ["".join(random.choice(letters) for _ in range(random.randint(0, 90))) for _ in range(2000)]
    own = packing.WordEncoder(packing.vocabulary_bytes(word_bpe_path()), remembered)
    for text, found in zip(texts, own.ids([t.encode() for t in texts])):
        assert found.tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_a_tokeniser_that_keeps_blanks_is_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="cannot be"):
        packing.WordEncoder(packing.vocabulary_bytes(public_tokenizers.path("byte_bpe_50k.json")))


def whole(sequences):
    """Per example key the (start, length) of its pieces in order."""
    out = {}
    for pieces in sequences:
        for example, length in pieces:
            out.setdefault(example.key, []).append((example.start, length))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("limits", [Limits(64, 4, 64), Limits(64, 100, 20), Limits(64, 3, 17)])
@pytest.mark.parametrize("cut", [True, False])
def test_limits_hold_and_every_token_lies_in_one_piece(limits, cut):
    random.seed(7)
    lengths = [random.choice([1, 2, 5, 17, 40, 64] + [200, 700] * cut) for _ in range(3000)]
    examples = [Example(i, np.arange(n, dtype="<u4"), 0, n - random.randint(1, min(n, limits.loss_tokens))) for i, n in enumerate(lengths)]
    packer = Packer(limits, cut)
    for example in examples:
        packer.add(example)
    packer.finish()
    for pieces in packer.ready:
        assert pieces
        tokens, loss = sum(p.length for p in pieces), sum(e.loss(n) for e, n in pieces)
        assert tokens <= limits.tokens and len(pieces) <= limits.segments and loss <= limits.loss_tokens
        assert not cut or tokens & tokens - 1 == 0
    for key, parts in whole(packer.ready).items():
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) == lengths[key]
        assert cut or len(parts) == 1
    assert len(whole(packer.ready)) == len(lengths)


def test_the_largest_dot_product_comes_first():
    packer = Packer(Limits(100, 10, 100), cut=False)
    for key, (n, loss) in enumerate([(60, 0), (60, 60), (30, 0), (30, 30)]):
        packer.add(Example(key, np.zeros(n, "<u4"), 0, n - loss))
    packer.finish()
    # the full-loss example asks for most; then its short twin; the two without loss make the second sequence
    assert [[p.example.key for p in pieces] for pieces in packer.ready] == [[1, 3], [0, 2]]


def test_prompts_bear_no_loss_and_uncut_examples_that_are_too_long_are_refused(spark):
    rows = spark.createDataFrame([(i, "a b c", "d e") for i in range(10)], "id long, ask string, text string")
    found = packing.packed(rows, word_bpe_path(), 2, Limits(64, 64, 6), cut=False, id_col="id", prompt_col="ask").collect()
    assert len(found) == 10 and {r["length"] for r in found} == {6}
    by = {}
    for r in found:
        by[r["sequence_id"]] = by.get(r["sequence_id"], 0) + 1
    assert max(by.values()) <= 2
    with pytest.raises(Exception, match="may not be cut"):
        packing.packed(rows, word_bpe_path(), 2, Limits(2, 64, 64), cut=False, id_col="id").collect()


def checked(frame, docs, library):
    """Rows of the operator hold every document's ids once, in gapless sequences without padding."""
    rows = frame.collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(docs)
    for key, text in docs.items():
        ids, at = ids_of(library, text), 0
        for r in sorted(by_doc[key], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & at - 1 == 0 and len(pieces) <= 128
    return rows


def test_query_packs_every_id_of_every_document(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = checked(op11_vector_packing(spark, sf), docs, library)
    assert len({r["sequence_id"] for r in rows if r["length"] == 4096}) >= 1


def test_operator_on_odd_rows(spark, make_docs, library):
    long = "word " * 300000
    docs = make_docs((1, None, "en", "s"), (2, "", None, None), (3, long, "en", "s"), *[(10 + i, t, "en", "s") for i, t in enumerate(ODD)])
    docs = docs.withColumn("start", docs["doc_id"]).withColumn("length", docs["doc_id"]).withColumn("prompt", docs["text"])
    checked(packing.packed(docs, word_bpe_path(), 2), {1: None, 2: "", 3: long, **{10 + i: t for i, t in enumerate(ODD)}}, library)
    twice = make_docs((None, "x y", None, None), (None, "x y", None, None), (5, "same", "en", "s"), (5, "same", "en", "s"))
    rows = packing.packed(twice, word_bpe_path(), 2).collect()
    assert [sum(r["length"] for r in rows if r["doc_id"] == k) for k in (None, 5)] == [6, 4]
    assert {(r["doc_id"], r["doc_tokens"]) for r in rows} == {(None, 3), (5, 2)}
    assert packing.packed(docs.limit(0), word_bpe_path(), 2).count() == 0
