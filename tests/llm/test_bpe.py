from __future__ import annotations

import hashlib
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")

from tenderloom.llm import bpe  # noqa: E402
from tenderloom.llm.queries import byte_bpe_path  # noqa: E402


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(byte_bpe_path())


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(byte_bpe_path(), remembered=50)


ODD = [
    "", " ", "a", "\n\n", "a  b \n c\n\n d", "it's we'll 'S  don't", "x<|endoftext|> <|endoftext|>y", "  lead", "trail  ",
    "\x1c\x1d a\x85b\xa0 c", "été über Ω≈ç 日本語テキスト ☃️ 👩‍👩‍👧 ١٢٣ ½²", "　 x", "x \xa0y\t z  \n", "ab" * 6000, " " * 700, "=" * 3000,
]


def test_equals_the_library_and_round_trips(own, library):
    random.seed(3)
    letters = "aeiou tnsrhldTHE'.,12 \n\xa0éèü日"
    texts = ODD + ["".join(random.choice(letters) for _ in range(random.randint(0, 90))) for _ in range(3000)]
    texts += ["".join(random.choice("eatnrsioth") for _ in range(9000))]
    for text, there in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text) == there.ids, text[:80]
        assert own.decode(there.ids) == library.decode(there.ids, skip_special_tokens=False) == text


def test_streaming_in_any_pieces_needs_a_bounded_buffer(own):
    random.seed(5)
    data = "".join(random.choice("eatnrsioth") for _ in range(30000)).encode()
    whole = own.encoder.encode(data, piece=len(data) + 1)
    for piece in (1, 7, 300):
        encoder = bpe.Encoder(own.v)
        out = [t for i in range(0, len(data), piece) for t in encoder.feed(data[i : i + piece])] + encoder.finish()
        assert out == whole
        assert encoder.widest <= 4 * encoder.keep + piece
    assert 0 < own.v.lookahead < 1000


def test_state_machine_splits_characters_anywhere():
    text = "aé日👩\U0010ffff" * 3
    data = text.encode()
    for step in (1, 2, 3, 5):
        machine = bpe.ByteToText()
        assert "".join(machine.feed(data[i : i + step]) for i in range(0, len(data), step)) + machine.finish() == text
    broken = b"a\xe2\x82"
    machine = bpe.ByteToText()
    assert machine.feed(broken) + machine.finish() == broken.decode(errors="replace")


def test_operator_on_odd_rows(spark, make_docs, library):
    docs = make_docs((1, None, "en", "s"), (1, None, "en", "s"), (None, "x y", None, None), (2, "", "en", "s"), (3, "word " * 30000, "en", "s"))
    rows = bpe.round_trip(docs, byte_bpe_path()).collect()
    assert len(rows) == 5
    empty = hashlib.sha256(b"").hexdigest()
    assert [r for r in rows if r["doc_id"] == 1] == [(1, 0, empty, empty)] * 2
    long = next(r for r in rows if r["doc_id"] == 3)
    ids = library.encode("word " * 30000, add_special_tokens=False).ids
    assert long["n_tokens"] == len(ids)
    assert long["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert long["decoded_sha256"] == hashlib.sha256(("word " * 30000).encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), byte_bpe_path()).count() == 0
    again = bpe.decode_documents(bpe.encode_documents(docs, byte_bpe_path()), byte_bpe_path()).filter("doc_id = 3").first()
    assert again["text"] == "word " * 30000
