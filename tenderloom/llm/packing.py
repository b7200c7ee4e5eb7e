"""Packing examples into training sequences by vector bin packing (operator 11).

A sequence has room for a number of tokens, of segments (pieces of examples) and of loss-bearing
tokens. An example asks for some of each. A task holds a bounded pool of examples and fills one
sequence after the other: among the examples that fit, it takes the one with the largest dot
product of its demand and the room that is left, each measured as a part of its limit, so a
dimension that is still empty counts most. When nothing fits whole any more, and cutting is
allowed, the best example's head fills the rest and its tail goes back to the pool.

Examples longer than a sequence are cut into full sequences first. A sequence that stays short, because its
segments are used up or the task has no more examples, is cut back to a power of two of tokens, a
length that needs no padding; what is cut off goes into the next sequence. So a task's last
examples make at most twelve short sequences. Without ``cut`` no example is divided (longer
ones are refused) and sequences keep their gaps.

No row is shuffled: a task packs the rows it reads. ``sequence_id`` is the task's number times 2^40 plus
a count, so the same input files give the same sequences; input whose order changes from run to run should be
written first.

Null texts are empty: an empty example is its end token alone. Every row is packed for itself,
rows with null or repeated ids too. Texts are tokenised in whole, word by word with a bounded
memory of the words seen; a word here is what ASCII blanks divide.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tenderloom.llm.common import ship, texts_as_bytes

POOL = 1024
SEQUENCE_BITS = 40
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
LARGEST_VOCABULARY = 64 << 20
SIGNS = b".,;:!?"


class Limits(NamedTuple):
    """What a sequence holds at most."""

    tokens: int = 4096
    segments: int = 128
    loss_tokens: int = 4096


class _Words(dict):
    """Ids of words as bytes, in two generations of ``remembered`` words; a word not known is encoded when asked for."""

    def __init__(self, encode: Callable[[bytes], bytes], merge: Callable[[bytes], bytes], remembered: int) -> None:
        super().__init__()
        self.encode, self.merge, self.remembered = encode, merge, remembered
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._new(word)
        if len(self) >= self.remembered:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _new(self, word: bytes) -> bytes:
        """Capitals and a sign behind a word give no entry of the library of their own."""
        if word.isascii() and b"<" not in word:
            if word[-1] in SIGNS and word[-2:-1].isalnum():
                return self[word[:-1]] + self[word[-1:]]
            lower = word.lower()
            if lower != word:
                return self[lower]
            if word.isalpha():
                return self.merge(word)
        return self.encode(word)


class WordEncoder:
    """Ids of the library, with a bounded memory of words.

    The tokeniser must lower-case, drop white space and never look beyond it or across the end of a word of letters
    and digits that one of ``SIGNS`` follows; ``check`` tests that on its settings. Special tokens in a text hold a "<".
    """

    def __init__(self, vocabulary: bytes, remembered: int = 400_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.check()
        self.words = _Words(self._encoded, self._merged, remembered)

    def _encoded(self, text: bytes) -> bytes:
        return array("I", self.library.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids).tobytes()

    def _merged(self, word: bytes) -> bytes:
        """A word of the letters a-z, which the library's normaliser and pre-tokeniser leave as it is."""
        return array("I", [t.id for t in self.library.model.tokenize(word.decode())]).tobytes()

    def check(self) -> None:
        probe = ["it's", "Été", "1a", "b\u0301", "\u0301x", "Abc", *(w + chr(s) for w in ("word", "B2") for s in SIGNS)]
        parts = [self._encoded(p.encode()) for p in probe]
        for blank in (" ", "\n", "\t \r", "\x0b\x0c"):
            if self._encoded(blank.join(probe).encode()) != b"".join(parts):
                raise ValueError("this tokeniser looks beyond blanks; words cannot be encoded one by one")
        for word, ids in zip(probe, parts):
            plain = word.lower().encode()
            cut = self._encoded(plain[:-1]) + self._encoded(plain[-1:]) if plain[-1] in SIGNS else self._encoded(plain)
            if word.isascii() and cut != ids or plain.isalpha() and self._merged(plain) != ids:
                raise ValueError("this tokeniser tells cases or signs behind words apart; words cannot be shared")

    def ids(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The ids of every text as unsigned 32-bit numbers."""
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(b"".join(map(get, part.split())) for part in _slices(text or b"")), "<u4") for text in texts]


_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")


def _slices(text: bytes, size: int = 1 << 18) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes that end at blanks."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + size)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes) -> WordEncoder:
    return WordEncoder(vocabulary)


class Example(NamedTuple):
    """What is left of an example: its ids from ``start`` on; ids before ``loss_from`` bear no loss."""

    key: int | None
    ids: np.ndarray
    start: int
    loss_from: int

    @property
    def tokens(self) -> int:
        return len(self.ids) - self.start

    def loss(self, length: int) -> int:
        return max(0, self.start + length - max(self.start, self.loss_from))

    def longest(self, tokens: int, loss: int) -> int:
        """Tokens of a head with at most so many tokens and loss-bearing tokens."""
        return min(tokens, self.tokens, max(0, self.loss_from - self.start) + loss)

    def after(self, length: int) -> Example:
        return self._replace(start=self.start + length)


class Piece(NamedTuple):
    example: Example
    length: int


class Packer:
    """Fills sequences from a pool of at most ``POOL`` examples and a sequence's pieces."""

    def __init__(self, limits: Limits, cut: bool = True) -> None:
        self.limits, self.cut = limits, cut
        self.pool: list[Example] = []
        self.demand = np.zeros((2 * POOL, 3), np.int64)
        self.ready: list[list[Piece]] = []

    def add(self, example: Example) -> None:
        limits = self.limits
        if not self.cut and (example.tokens > limits.tokens or example.loss(example.tokens) > limits.loss_tokens):
            raise ValueError(f"example {example.key} exceeds a sequence and may not be cut")
        while example.tokens >= limits.tokens and example.longest(limits.tokens, limits.loss_tokens) == limits.tokens:
            self.ready.append([Piece(example, limits.tokens)])
            example = example.after(limits.tokens)
        if example.tokens:
            self._put(example)
        while len(self.pool) >= POOL:
            self.ready.append(self.sequence())

    def finish(self) -> None:
        while self.pool:
            self.ready.append(self.sequence())

    def _put(self, example: Example) -> None:
        at = len(self.pool)
        if at == len(self.demand):
            self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)])
        self.pool.append(example)
        self.demand[at] = (example.tokens, 1, example.loss(example.tokens))

    def _take(self, at: int) -> Example:
        example, last = self.pool[at], self.pool.pop()
        if at < len(self.pool):
            self.pool[at] = last
            self.demand[at] = self.demand[len(self.pool)]
        return example

    def sequence(self) -> list[Piece]:
        limit = np.array(self.limits, np.int64)
        room, chosen = limit.copy(), []
        while self.pool and room.all():
            demand = self.demand[: len(self.pool)]
            product = demand @ (room / (limit * limit).astype(float))
            fits = (demand <= room).all(axis=1)
            if fits.any():
                example = self._take(int(np.argmax(np.where(fits, product, -1.0))))
                length = example.tokens
            elif self.cut:
                example = self._take(int(np.argmax(product)))
                length = example.longest(int(room[0]), int(room[2]))
                if example.tokens > length:
                    self._put(example.after(length))
            else:
                break
            chosen.append(Piece(example, length))
            room -= (length, 1, example.loss(length))
        return self._shortened(chosen) if self.cut else chosen

    def _shortened(self, chosen: list[Piece]) -> list[Piece]:
        """The pieces cut back to a power of two of tokens, unless the sequence is full."""
        total = sum(p.length for p in chosen)
        over = 0 if total == self.limits.tokens else total - (1 << total.bit_length() - 1)
        while over:
            example, length = chosen.pop()
            kept = max(0, length - over)
            if kept:
                chosen.append(Piece(example, kept))
            rest = example.after(kept)
            if kept + rest.tokens > length:  # its tail is in the pool already: put both together again
                tail = next(i for i, e in enumerate(self.pool) if e.ids is example.ids and e.start == example.start + length)
                self._take(tail)
            self._put(rest)
            over -= length - kept
        return chosen


def _rows(sequences: list[list[Piece]], first: int) -> pa.RecordBatch:
    rows = []
    for number, pieces in enumerate(sequences, first):
        offset = 0
        for example, length in pieces:
            part = example.ids[example.start : example.start + length]
            rows.append((example.key, example.start, length, zlib.crc32(part), len(example.ids), number, offset))
            offset += length
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [f.split()[0] for f in OUT.split(", ")])


def vocabulary_bytes(path: str) -> bytes:
    """A tokeniser's file, read on the driver; its size is the bound of what is sent to the executors."""
    with open(path, "rb") as file:
        data = file.read(LARGEST_VOCABULARY + 1)
    if len(data) > LARGEST_VOCABULARY:
        raise ValueError(f"the vocabulary {path} is larger than {LARGEST_VOCABULARY} bytes")
    return data


def packed(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    limits: Limits = Limits(),
    cut: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    An example's ids are those of its prompt, if there is one, and of its text, then ``end_id``. The prompt
    bears no loss. ``offset`` is the piece's place in its sequence; pieces follow each other without gaps.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    prompt = F.lit(None).cast("string") if prompt_col is None else F.col(prompt_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), prompt.alias("prompt"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = encoder(sent.value), Packer(limits, cut)
        number = TaskContext.get().partitionId() << SEQUENCE_BITS
        end = np.array([end_id], "<u4")
        for batch in batches:
            keys = batch.column(0).to_pylist()
            prompts, texts = (own.ids(texts_as_bytes(batch.column(i))) for i in (1, 2))
            for key, asked, answer in zip(keys, prompts, texts):
                packer.add(Example(key, np.concatenate([asked, answer, end]), 0, len(asked)))
                if len(packer.ready) >= 512:
                    yield _rows(packer.ready, number)
                    number += len(packer.ready)
                    packer.ready = []
        packer.finish()
        if packer.ready:
            yield _rows(packer.ready, number)

    ship(docs.sparkSession)
    return narrow.mapInArrow(run, OUT)
