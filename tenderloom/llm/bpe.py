"""Byte-pair encoding and decoding as streaming transducers (operator 1).

Encoding rests on two facts about a merge list in which a merge follows those that make its
parts. A sequence of tokens is the encoding of its bytes if and only if no merge fires across
any of its inner boundaries before the tokens on both sides are used up by their own merges.
So every prefix of the input has exactly one last token, and the encodings of all prefixes
form a tree. Tokens that all live branches share are stable and leave the buffer.

``lookahead`` is computed from the merge list: how many bytes to the right can decide whether
a merge fires. The buffer never needs more than that plus the longest token, whatever the
length of the text.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tenderloom.llm.common import map_batches

# The pre-tokeniser's pattern, with the letter, number and space classes named.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{S}{l}{n}]+|[{S}]+(?![^{S}])|[{S}]+"
_ANY = regex.compile(
    PATTERN.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}").replace("{l}", r"\p{L}").replace("{n}", r"\p{N}").replace("{S}", r"\p{White_Space}")
)
# Texts below this code point use the standard library's matcher with the classes spelled out.
_NARROW_END = 0x250


def _narrow() -> re.Pattern:
    chars = [chr(c) for c in range(_NARROW_END)]
    letters = "".join(map(re.escape, (c for c in chars if unicodedata.category(c)[0] == "L")))
    numbers = "".join(map(re.escape, (c for c in chars if unicodedata.category(c)[0] == "N")))
    spaces = "\t\n\x0b\x0c\r \x85\xa0"
    text = PATTERN.replace("{L}", f"[{letters}]").replace("{N}", f"[{numbers}]")
    return re.compile(text.replace("{l}", letters).replace("{n}", numbers).replace("{S}", spaces))


_NARROW = _narrow()
_WIDE_CHAR = re.compile(f"[^\\x00-{chr(_NARROW_END - 1)}]")
_SPACE_END = re.compile(r"[\s\x85\xa0]")
# White space beside a space or a line end, or at an end of the piece (one space may lead it).
_UNSAFE = re.compile(r"[ \n][\s\x85\xa0]|[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u3000][ \n]|\A[^\S ]|\A\Z|[\s\x85\xa0]\Z")


def pretokens(text: str) -> list[str]:
    return (_ANY if _WIDE_CHAR.search(text) else _NARROW).findall(text)


@lru_cache(maxsize=1)
def _byte_of_char() -> dict[str, int]:
    """The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        table[chr(256 + i)] = b
    return table


class Vocabulary:
    """Tokens, merges and what follows from them."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int]) -> None:
        self.special = special
        self.bytes_of = {i: b for b, i in tokens.items()} | {i: s.encode() for s, i in special.items()}
        self.rank = {(tokens[a], tokens[b]): r for r, (a, b) in enumerate(merges)}
        self.made = {tokens[a + b]: (tokens[a], tokens[b], r) for r, (a, b) in reversed(list(enumerate(merges)))}
        self.longest = max(map(len, tokens))
        self.trie: dict = {}
        for data, token in tokens.items():
            node = self.trie
            for byte in data:
                node = node.setdefault(byte, {})
            node[-1] = token
        self._edges: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.known_fits: dict[int, bool] = {}
        self.token_of = tokens
        self.lookahead = self._lookahead()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        char = _byte_of_char()
        data = lambda s: bytes(char[c] for c in s)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        tokens = {data(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        return cls(tokens, [(data(a), data(b)) for a, b in pairs], special)

    def edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """Tokens that stand at one end of ``token`` while it is built, each with the rank of the
        merge that uses it up (the token itself: none)."""
        key = (token, right)
        if key not in self._edges:
            spine, until = [], len(self.rank)
            while True:
                spine.append((token, until))
                parts = self.made.get(token)
                if parts is None:
                    break
                token, until = parts[1 if right else 0], parts[2]
            self._edges[key] = spine
        return self._edges[key]

    def fits(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow ``a``: no merge fires across their boundary.

        Among equal ranks the leftmost pair goes first, so a merge inside ``a`` of the same
        rank precedes the one across, and that precedes one inside ``b``.
        """
        key = a << 32 | b
        known = self.known_fits.get(key)
        if known is None:
            known = True
            for left, used_left in self.edge(a, True):
                for right, used_right in self.edge(b, False):
                    rank = self.rank.get((left, right))
                    if rank is not None and rank < used_left and rank <= used_right:
                        known = False
                        break
                if not known:
                    break
            if len(self.known_fits) >= 1 << 20:
                self.known_fits.clear()
            self.known_fits[key] = known
        return known

    def _lookahead(self) -> int:
        """Bytes to the right that can decide whether a token stays.

        Whether ``a`` is used up by merge (a, b) depends on ``b``, and ``b`` on what follows it,
        through merges of lower rank only; so the longest chain is found in order of rank.
        """
        by_left: dict[int, tuple[list[int], list[int]]] = {}
        lengths = {t: len(b) for t, b in self.bytes_of.items()}

        def reach(token: int, before: int) -> int:
            most = 0
            for part, used in self.edge(token, True):
                ranks, best = by_left.get(part, ((), ()))
                i = bisect.bisect_left(ranks, min(used, before))
                most = max(most, best[i - 1] if i else 0)
            return most

        for (left, right), rank in sorted(self.rank.items(), key=lambda x: x[1]):
            chain = lengths[right] + reach(right, rank)
            ranks, best = by_left.setdefault(left, ([], []))
            ranks.append(rank)
            best.append(max(chain, best[-1] if best else 0))
        return max((best[-1] for _, best in by_left.values()), default=0)


class Encoder:
    """Bytes in, stable tokens out; the bytes of one pre-token arrive in pieces of any size."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.keep = vocabulary.lookahead + vocabulary.longest
        self.widest = 0
        self._reset()

    def _reset(self) -> None:
        self.buffer = bytearray()
        self.last: list[tuple[int, int] | None] = [(0, -1)]  # per prefix: start of its last token, the token
        self.before = -1  # the token ahead of the buffer
        self.scanned = 0

    def _advance(self, final: bool) -> None:
        """Extend the tree of prefixes. A position is scanned when no unseen byte can lengthen its tokens."""
        data, last, v = self.buffer, self.last, self.v
        n = len(data)
        last.extend([None] * (n + 1 - len(last)))
        end = n if final else max(self.scanned, n - v.longest)
        for i in range(self.scanned, end):
            if last[i] is None:
                continue
            previous = last[i][1]
            node = v.trie
            for j in range(i, n):
                node = node.get(data[j])
                if node is None:
                    break
                token = node.get(-1)
                if token is not None and last[j + 1] is None and (previous < 0 or v.fits(previous, token)):
                    last[j + 1] = (i, token)
        self.scanned = end

    def _path(self, tip: int) -> list[tuple[int, int]]:
        path = []
        while tip:
            start, token = self.last[tip]
            path.append((tip, token))
            tip = start
        return path[::-1]

    def feed(self, data: bytes) -> Iterator[int]:
        self.buffer += data
        self.widest = max(self.widest, len(self.buffer))
        self._advance(False)
        if self.scanned < 2 * self.keep:
            return
        # every future token starts at a live prefix: what their paths share is stable
        live = [i for i in range(max(0, self.scanned - self.v.longest), self.scanned + 1) if self.last[i] is not None]
        shared = self._path(live[0])
        for tip in live[1:]:
            at = dict(self._path(tip))
            while shared and at.get(shared[-1][0]) != shared[-1][1]:
                shared.pop()
        if not shared:
            return
        cut = shared[-1][0]
        yield from (token for _, token in shared)
        self.before = shared[-1][1]
        del self.buffer[:cut]
        self.last = [(0, self.before)] + [x and (x[0] - cut, x[1]) for x in self.last[cut + 1 :]]
        self.scanned -= cut

    def finish(self) -> list[int]:
        self._advance(True)
        tokens = [token for _, token in self._path(len(self.buffer))]
        self._reset()
        return tokens

    def _short(self, data: bytes) -> list[int]:
        """The same tree for input that is here as a whole, longest tokens first.

        A prefix has one encoding only, so a prefix that leads nowhere is never tried again.
        """
        v, n = self.v, len(data)
        whole = v.token_of.get(data)
        if whole is not None:
            return [whole]
        trie, fits, known = v.trie, v.fits, v.known_fits
        path: list[tuple[int, int, list]] = []
        dead = set()
        at, previous, found = 0, -1, None
        while at < n:
            if found is None:
                node, found, j = trie, [], at
                while j < n:
                    node = node.get(data[j])
                    if node is None:
                        break
                    j += 1
                    token = node.get(-1)
                    if token is not None:
                        found.append((j, token))
            while found:
                end, token = found.pop()
                if end in dead:
                    continue
                if previous >= 0:
                    fit = known.get(previous << 32 | token)
                    if not (fits(previous, token) if fit is None else fit):
                        continue
                path.append((at, previous, found))
                at, previous, found = end, token, None
                break
            else:
                dead.add(at)
                at, previous, found = path.pop()
        return [p[1] for p in path[1:]] + [previous] if path else []

    def encode(self, data: bytes, piece: int = 4096) -> list[int]:
        if len(data) <= self.keep:
            return self._short(data)
        out: list[int] = []
        for i in range(0, len(data), piece):
            out.extend(self.feed(data[i : i + piece]))
        return out + self.finish()


class ByteToText:
    """Bytes to text piece by piece; holds back at most three bytes of an unfinished character."""

    def __init__(self) -> None:
        self.rest = b""

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                if need > back:
                    cut = len(data) - back
                break
            if byte < 0x80:
                break
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", errors="replace")

    def finish(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", errors="replace")


class _Memory(dict):
    """Text unit to its token ids as text; bounded by two generations."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, unit: str) -> str:
        known = self.old.get(unit)
        if known is None:
            known = self.make(unit)
        if len(unit) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[unit] = known
        return known


class Codec:
    """Whole texts: pre-tokenise, encode by the transducer, decode by the state machine."""

    PIECE = 1 << 16

    def __init__(self, path: str, remembered: int = 200_000) -> None:
        self.v = Vocabulary.load(path)
        self.encoder = Encoder(self.v)
        self.words = _Memory(self._word, remembered)
        self.units = _Memory(self._unit, remembered)
        self.spaced = _Memory(lambda word: self._unit(" " + word), remembered)
        self.line_end = "," + self._word("\n") + ","
        self.bytes_of = {str(i): b for i, b in self.v.bytes_of.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, self.v.special)) + ")") if self.v.special else None

    def _word(self, word: str) -> str:
        return ",".join(map(str, self.encoder.encode(word.encode())))

    def _unit(self, unit: str) -> str:
        return ",".join(map(self.words.__getitem__, pretokens(unit)))

    def ids(self, text: str) -> Iterator[str]:
        """Token ids joined by commas, piece by piece."""
        parts = self.split.split(text) if self.split and any(s in text for s in self.v.special) else [text]
        for part in parts:
            if part in self.v.special:
                yield str(self.v.special[part])
            elif part:
                yield from self._plain(part)

    def _plain(self, text: str) -> Iterator[str]:
        start = 0
        while start < len(text):
            end = min(len(text), start + self.PIECE)
            while end < len(text) and not self._safe(text, end):
                end += 1
            piece = text[start:end]
            yield self._piece(piece)
            start = end

    @staticmethod
    def _safe(text: str, at: int) -> bool:
        """A single space between two characters that are no space always starts a pre-token."""
        return text[at] == " " and at + 1 < len(text) and not _SPACE_END.match(text[at + 1]) and not _SPACE_END.match(text[at - 1])

    def _piece(self, piece: str) -> str:
        """Lines and words are units where single spaces and line ends stand between other characters."""
        if _UNSAFE.search(piece):
            return self._loose(piece)
        units, spaced = self.units, self.spaced
        lines = []
        for line in piece.split("\n"):
            words = line.split(" ")
            first = words[0]
            del words[0]
            if not words:
                lines.append(units[first])
            elif first:
                lines.append(units[first] + "," + ",".join(map(spaced.__getitem__, words)))
            else:
                lines.append(",".join(map(spaced.__getitem__, words)))
        return self.line_end.join(lines)

    def _loose(self, piece: str) -> str:
        """Units next to other white space stay together."""
        words = piece.split(" ")
        units = [words[0]]
        open_end = not words[0] or _SPACE_END.match(words[0][-1]) is not None
        for word in words[1:]:
            if open_end or not word or _SPACE_END.match(word[0]):
                units[-1] += " " + word
            else:
                units.append(" " + word)
            open_end = not word or _SPACE_END.match(word[-1]) is not None
        if not units[0]:
            del units[0]
        return ",".join(map(self.units.__getitem__, units))

    def summary(self, text: str | None) -> tuple[int, str, str]:
        """Token count, hash of the ids, hash of the text decoded from those ids."""
        ids, decoded, decoder, n = hashlib.sha256(), hashlib.sha256(), ByteToText(), 0
        for piece in self.ids(text or ""):
            if n:
                ids.update(b",")
            ids.update(piece.encode())
            tokens = piece.split(",")
            n += len(tokens)
            decoded.update(decoder.feed(b"".join(map(self.bytes_of.__getitem__, tokens))).encode())
        decoded.update(decoder.finish().encode())
        return n, ids.hexdigest(), decoded.hexdigest()

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for piece in self.ids(text or "") for i in piece.split(",")]

    def decode(self, ids: Iterable[int]) -> str:
        decoder = ByteToText()
        out = [decoder.feed(self.v.bytes_of[i]) for i in ids if i in self.v.bytes_of]
        return "".join(out) + decoder.finish()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (id, text) with ``token_ids`` array<int>; a null text has no tokens. No shuffle."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(vocabulary)
        ids = [own.encode(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, token_ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids); null ids give an empty text, unknown ids are skipped."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(vocabulary)
        texts = [own.decode(x or ()) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "token_ids"), work, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256. Nulls count as empty texts.

    Texts are encoded and decoded piece by piece, so memory beyond the row itself is constant.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(vocabulary)
        rows = [own.summary(t) for t in batch.column(1).to_pylist()]
        counts, ids, texts = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(narrow, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
