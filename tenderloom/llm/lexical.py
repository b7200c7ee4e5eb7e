"""Ranked lexical search over a K2-treap of the term-document grid (operator 13).

The documents are indexed in shards of bounded size. A shard is a grid: a row per term, most
frequent first, a column per document, and in a cell the impact of the term in the document. The
grid is stored as a K2-treap: a node of the quadtree holds the largest impact of its square with
its row and column, that point is taken out of the square, and what is left is divided into
four. Empty squares have no node, so there is one node per posting: 64 bits with impact, row,
column and which quadrants go on. Nodes lie level by level, so a child is found by counting bits.

An item's terms are rows of the grid. Their paths from the root to the row are followed jointly over
ranges of documents: a range knows the node of every term. Its bound is the sum of weight times the node's impact,
plus the most that one of its documents has got from the points already met. Ranges are taken
best first, a batch at a time, and halved, until no bound reaches the last place of the best documents
found; then all documents in the running are complete. Tasks carry the last place on from
shard to shard, and the short lists of all tasks are merged.

Numbers over the whole table (documents, terms, document frequencies of the items' terms)
come first. Items are asked in blocks, each of which is sent to all tasks; a block has a bounded
number of terms.

Terms are kept as 64-bit hashes: with a billion different terms, the chance that any of 10,000 asked ones shares
its hash with another is below one in a million. Null and termless texts are no documents and match nothing, null and
termless items have no rows. Documents with a null id count but are not ranked. Rows
that repeat an id are documents of their own; items that repeat an id with other texts are ranked each for itself, and equal
ones once. Texts are read in slices at term ends, so a long one costs memory for its distinct terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tenderloom.llm.common import hashed_spans, map_batches, ship, stored, texts_as_bytes

POSTINGS = 1 << 19
BLOCK_TERMS = 1 << 16
LARGEST_BLOCK = 64 << 20
BATCH = 256
SLICE = 1 << 22

_TERM_BYTE = np.ones(256, bool)
_TERM_BYTE[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_ONES = np.array([bin(i).count("1") for i in range(16)], np.int64)

# A node: impact (20 bits), row and column (40 bits together, the row's share is the shard's), quadrants (4 bits).
IMPACT_BITS, PLACE_BITS = 20, 40


def term_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every term of a UTF-8 text, in order; only A-Z are lower-cased."""
    out, at = [], 0
    while at < len(data):
        end = at + SLICE
        while end < len(data) and _TERM_BYTE[data[end]]:
            end += 1
        raw = np.frombuffer(data[at:end].lower(), np.uint8)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = _TERM_BYTE[raw]
        step = np.diff(inside)
        out.append(hashed_spans(raw, np.flatnonzero(step == 1), np.flatnonzero(step == -1)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """(1000000000 tf) div (1000 tf + 20 m), below a million, in 64-bit integers."""
    m = 50 + (50 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


# ---------------------------------------------------------------- the treap


def _interleaved(rows: np.ndarray, columns: np.ndarray, height: int) -> np.ndarray:
    code = np.zeros(len(rows), np.uint64)
    for bit in range(height):
        code |= ((rows >> bit & 1) << (2 * bit + 1) | (columns >> bit & 1) << (2 * bit)).astype(np.uint64)
    return code


def treap(rows: np.ndarray, columns: np.ndarray, impact: np.ndarray, height: int, row_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the number of them on every level, for distinct points of a square of 2^height rows and columns."""
    code = _interleaved(rows, columns, height)
    order = np.argsort(code)
    code, rows, columns, impact = code[order], rows[order], columns[order], impact[order]
    place = (rows.astype(np.uint64) | columns.astype(np.uint64) << np.uint64(row_bits)) << np.uint64(IMPACT_BITS)
    levels, above = [], None
    for level in range(height + 1):
        if not len(code):
            break
        cell = code >> np.uint64(2 * (height - level))
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        lengths = np.diff(np.append(first, len(cell)))
        top = np.repeat(np.maximum.reduceat(impact, first), lengths)
        at_top = np.flatnonzero(impact == top)
        owner = np.searchsorted(first, at_top, side="right")
        chosen = at_top[np.concatenate(([True], owner[1:] != owner[:-1]))]
        nodes = impact[chosen].astype(np.uint64) | place[chosen]
        if above is not None:  # tell the nodes above which of their quadrants go on
            parent = cell[first] >> np.uint64(2)
            begins = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
            mask = np.bitwise_or.reduceat(np.uint64(1) << (cell[first] & np.uint64(3)), begins)
            levels[-1][np.searchsorted(above, parent[begins])] |= mask << np.uint64(IMPACT_BITS + PLACE_BITS)
        levels.append(nodes)
        above = cell[first]
        left = np.ones(len(code), bool)
        left[chosen] = False
        code, impact, place = code[left], impact[left], place[left]
    return np.concatenate(levels), np.array([len(x) for x in levels], np.int64)


class Shard:
    """A treap ready for searching."""

    def __init__(self, ids: bytes, terms: bytes, rows: bytes, nodes: bytes, height: int, row_bits: int) -> None:
        self.ids, self.terms, self.rows = np.frombuffer(ids, np.int64), np.frombuffer(terms, np.uint64), np.frombuffer(rows, np.uint32)
        node = np.frombuffer(nodes, np.uint64)
        self.height = height
        self.impact = (node & np.uint64((1 << IMPACT_BITS) - 1)).astype(np.int64)
        place = node >> np.uint64(IMPACT_BITS) & np.uint64((1 << PLACE_BITS) - 1)
        self.row = (place & np.uint64((1 << row_bits) - 1)).astype(np.int64)
        self.column = (place >> np.uint64(row_bits)).astype(np.int64)
        self.mask = (node >> np.uint64(IMPACT_BITS + PLACE_BITS)).astype(np.int64)
        # level by level: the children of a node follow those of all nodes before it
        ones = _ONES[self.mask]
        self.child = 1 + np.cumsum(ones) - ones
        self.below = np.zeros(len(node), np.int64)  # the largest impact under a node, without its own point
        inner = np.flatnonzero(self.mask)
        if len(inner):
            self.below[inner] = np.maximum.reduceat(self.impact, self.child[inner])
        self.width = max(0, int(len(self.ids) - 1).bit_length())

    def rows_of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms the shard holds, and their rows."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        held = self.terms[at] == terms
        return held, self.rows[at[held]].astype(np.int64)

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of documents that may be among the ``k`` best and reach ``least``; their scores are complete."""
        size, height = 1 << self.width, self.height
        got = np.zeros(2 * size, np.int64)  # a heap over document ranges: the most one document of the range has got
        tail = got[size : size + len(self.ids)]

        def meet(nodes: np.ndarray, term: np.ndarray) -> None:
            """Take up the points of the nodes that lie in their term's row."""
            own = np.flatnonzero(self.row[nodes] == rows[term])
            np.add.at(got, size + self.column[nodes[own]], weights[term[own]] * self.impact[nodes[own]])

        def raised() -> None:
            low = size
            while low > 1:
                np.maximum(got[low : 2 * low : 2], got[low + 1 : 2 * low : 2], out=got[low // 2 : low])
                low //= 2

        start = np.zeros((1, len(rows)), np.int64)
        meet(start[0], np.arange(len(rows)))
        raised()
        if not self.mask[0]:
            start -= 1
        least = max(least, 1)
        # a range: its bound, its place in the heap of ranges, the level of its nodes, and its terms' nodes
        bounds = got[1:2] + np.where(start >= 0, self.below[start], 0) @ weights
        places, levels, nodes = np.ones(1, np.int64), np.zeros(1, np.int64), start
        while True:
            if len(tail) >= k:
                least = max(least, int(np.partition(tail, len(tail) - k)[len(tail) - k]))
            left = np.flatnonzero(bounds >= least)
            if not len(left):
                break
            if len(left) > BATCH:
                left = left[np.argpartition(-bounds[left], BATCH)]
            taken, kept = left[:BATCH], left[BATCH:]
            place, level, node = places[taken], levels[taken], nodes[taken]
            shift = height - level - 1
            row_bit = rows[None, :] >> shift[:, None] & 1
            splits = shift < self.width  # above that, all documents lie in the left half
            mask, first = np.where(node >= 0, self.mask[node], 0), self.child[node]
            halves = []
            for side in (0, 1):
                quadrant = 2 * row_bit + side
                there = mask >> quadrant & 1 == 1
                if side:
                    there &= splits[:, None]
                child = np.where(there, first + _ONES[mask & (1 << quadrant) - 1], -1)
                x, y = np.nonzero(there)
                meet(child[x, y], y)
                child[self.mask[child] * there == 0] = -1  # met, and nothing below
                halves.append(child)
            raised()
            node = np.concatenate(halves)
            place = np.concatenate([np.where(splits, 2 * place, place), 2 * place + 1])
            rest = np.where(node >= 0, self.below[node], 0) @ weights
            more = np.flatnonzero(rest)
            bounds = np.concatenate([bounds[kept], rest[more] + got[place[more]]])
            places = np.concatenate([places[kept], place[more]])
            levels = np.concatenate([levels[kept], np.tile(level + 1, 2)[more]])
            nodes = np.concatenate([nodes[kept], node[more]])
        found = np.flatnonzero(tail >= least)
        return found, tail[found]


def _selected(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


# ---------------------------------------------------------------- the index


class Totals(NamedTuple):
    documents: int
    terms: int


def term_count(data: bytes) -> int:
    raw = np.frombuffer(data, np.uint8)
    inside = _TERM_BYTE[raw]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]) + (len(inside) > 0 and inside[0]))


def totals(docs: DataFrame, text_col: str = "text") -> Totals:
    """How many texts have a term, and their terms with repeats."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = np.array([term_count(t or b"") for t in texts_as_bytes(batch.column(0))])
        return pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["documents", "terms"])

    counted = map_batches(docs.select(F.col(text_col).alias("text")), work, "documents long, terms long")
    row = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "terms")]).first()
    return Totals(row["documents"], row["terms"])


INDEX = "ids binary, terms binary, frequencies binary, rows binary, nodes binary, height int, row_bits int"


def index(docs: DataFrame, whole: Totals, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards, one row each: at most ``POSTINGS`` postings or one document. No shuffle."""

    def shard(ids: list, found: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t, _, _ in found])
        column = np.repeat(np.arange(len(found)), sizes)
        terms, term_at = np.unique(np.concatenate([t for t, _, _ in found]), return_inverse=True)
        frequency = np.bincount(term_at)
        row_of = np.empty(len(terms), np.int64)
        row_of[np.argsort(-frequency, kind="stable")] = np.arange(len(terms))
        lengths = np.repeat(np.array([n for _, _, n in found], np.int64), sizes)
        impact = impacts(np.concatenate([c for _, c, _ in found]).astype(np.int64), lengths, *whole)
        row_bits = max(1, int(len(terms) - 1).bit_length())
        height = max(row_bits, int(len(found) - 1).bit_length())
        # documents with no id count, but are not points of the grid
        named = np.repeat(np.array([i is not None for i in ids]), sizes)
        if named.any():
            nodes, _ = treap(row_of[term_at][named], column[named], impact[named], height, row_bits)
        else:
            nodes = np.zeros(0, np.uint64)
        parts = (np.array([i or 0 for i in ids], np.int64), terms, frequency.astype(np.uint32), row_of.astype(np.uint32), nodes)
        return pa.RecordBatch.from_arrays(
            [*(pa.array([p.tobytes()], pa.binary()) for p in parts), pa.array([height], pa.int32()), pa.array([row_bits], pa.int32())],
            [f.split()[0] for f in INDEX.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, size = [], [], 0
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1))):
                hashes = term_hashes(data or b"")
                if not len(hashes):
                    continue
                terms, counts = np.unique(hashes, return_counts=True)
                if found and size + len(terms) > POSTINGS:
                    yield shard(ids, found)
                    ids, found, size = [], [], 0
                ids.append(key)
                found.append((terms, counts, len(hashes)))
                size += len(terms)
        if found:
            yield shard(ids, found)

    ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, INDEX)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, digest, term): the distinct terms of every distinct item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(texts_as_bytes(batch.column(2))):
                terms = np.unique(term_hashes(data or b"")).view(np.int64)
                if len(terms):
                    one = pa.array(np.full(len(terms), i))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(one), batch.column(1).take(one), pa.array(terms, pa.int64())], ["item_id", "digest", "term"]
                    )

    ship(items.sparkSession)
    text = F.col(text_col)
    narrow = items.select(F.col(id_col).cast("long").alias("item_id"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    asked = narrow.filter("text is not null").mapInArrow(run, "item_id long, digest string, term long")
    return asked.distinct()


def weighted(asked: DataFrame, shards: DataFrame, whole: Totals) -> DataFrame:
    """(item_id, digest, term, weight): floor(1000 ln((2N + 2) / (2 df + 1))); terms of no document are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1)):
                term = np.frombuffer(terms.as_py(), np.int64)
                count = np.frombuffer(counts.as_py(), np.uint32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(count)], ["term", "df"])

    held = shards.select("terms", "frequencies").mapInArrow(run, "term long, df long")
    # a row per shard at most for every asked term
    frequency = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * whole.documents + 2)) / (2 * F.col("df") + 1)))
    return asked.join(frequency.select("term", weight.alias("weight")), "term").select("item_id", "digest", "term", "weight")


def search(shards: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(item_id, digest, doc_id, score): per task at most ``k`` documents of every question.

    ``questions`` (item_id, digest, term, weight) are asked block by block, each block of all shards.
    """
    spark = shards.sparkSession
    whole = questions.groupBy("item_id", "digest").agg(
        F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights")  # an item's own terms
    )
    sized = stored(whole.withColumn("size", F.size("terms")), "questions")
    total = sized.agg(F.sum("size").alias("t")).first()["t"] or 0
    blocks = -(-total // BLOCK_TERMS)
    numbered = sized.withColumn("block", F.pmod(F.xxhash64("item_id", "digest"), F.lit(max(1, blocks))))
    largest = numbered.groupBy("block").agg(F.sum("size").alias("s")).agg(F.max("s").alias("s")).first()["s"] or 0
    if 16 * largest > LARGEST_BLOCK:
        raise ValueError(f"an item or a block of them has {largest} terms, more than can be sent to a task")
    out = "item_id long, digest string, doc_id long, score long"
    found = spark.createDataFrame([], out)
    for block in range(blocks):
        rows = numbered.filter(F.col("block") == block).select("item_id", "digest", "terms", "weights").collect()
        sent = spark.sparkContext.broadcast(
            [(r["item_id"], r["digest"], np.array(r["terms"], np.int64).view(np.uint64), np.array(r["weights"], np.int64)) for r in rows]
        )
        found = found.unionByName(stored(_answered(shards, sent, k, out), "answers"))
    return found


def _answered(shards: DataFrame, sent, k: int, out: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in asked]
        for batch in batches:
            for row in range(batch.num_rows):
                if not len(batch.column(3)[row].as_py()):
                    continue
                shard = Shard(*(batch.column(c)[row].as_py() for c in range(6)))
                for i, (_, _, terms, weights) in enumerate(asked):
                    held, rows = shard.rows_of(terms)
                    use = weights[held]
                    if not use.any():
                        continue
                    ids, scores = best[i]
                    least = int(scores[-1]) if len(scores) == k else 1
                    columns, new = shard.best(rows[use > 0], use[use > 0], k, least)
                    if len(columns):
                        best[i] = _selected(np.concatenate([ids, shard.ids[columns]]), np.concatenate([scores, new]), k)
        frames = [
            pd.DataFrame({"item_id": pd.array([item] * len(ids), "Int64"), "digest": digest, "doc_id": ids, "score": scores})
            for (item, digest, _, _), (ids, scores) in zip(asked, best)
            if len(ids)
        ]
        if frames:
            schema = pa.schema([("item_id", pa.int64()), ("digest", pa.string()), ("doc_id", pa.int64()), ("score", pa.int64())])
            yield from pa.Table.from_pandas(pd.concat(frames, ignore_index=True), schema=schema, preserve_index=False).to_batches()

    ship(shards.sparkSession)
    return shards.select("ids", "terms", "rows", "nodes", "height", "row_bits").mapInArrow(run, out)


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` documents of highest score above 0, ties by ascending doc_id."""
    whole = totals(docs, text_col)
    shards = stored(index(docs, whole, id_col, text_col), "index")
    asked = stored(item_terms(items, item_col, item_text_col), "asked")
    found = search(shards, weighted(asked, shards, whole), k)
    best = Window.partitionBy("item_id", "digest").orderBy(F.desc("score"), "doc_id")
    rank = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return rank.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
