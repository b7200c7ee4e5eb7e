"""Repeated passages by a sparse suffix array (operator 8).

Suffixes of the word sequences are kept only at positions chosen by content: minimisers of
the hashes of 25-word runs. A passage of 50 words or more that two documents share has at
least one such position in common. Positions whose run occurs in one document only are
dropped; the others are sorted by what follows, neighbours in that order are compared, and
matches are extended word by word to the right and to the left. A match of ``min_words`` or
more marks its span in both documents. The neighbour is the best partner to the right; where
more than two suffixes share a run, another partner may reach further to the left, so all
windows of ``min_words`` around such a position are compared by hash as well.

Documents whose words are all the same are one document for the search; each such copy is
repeated as a whole. Rows with a null id or text, and texts shorter than ``min_words``,
have no spans. Words are compared without regard to the case of A-Z.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenderloom.llm.common import gram_hashes, map_batches, map_groups, minimisers, mixed, ship, stored, syncmers, texts_as_bytes, word_hashes

MIN_WORDS = 50


def text_classes(
    docs: DataFrame, shapes: list[tuple[int, int | None]], least: int, id_col: str, text_col: str
) -> tuple[DataFrame, DataFrame]:
    """Per document its words' digest and its selected positions; and the classes of equal words.

    ``shapes`` are (words in a run, window of runs; None for syncmers). Returns (profiles: doc_id, n_words, digest,
    anchors: hashes of the runs, places, sizes, turns: how often the hash came before) and (classes: digest, head, copies).
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, digests, anchors, places, sizes, turns = [], [], [], [], [], []
        for data in texts_as_bytes(batch.column(1)):
            words = word_hashes(data or b"")
            lengths.append(len(words))
            if len(words) < least:
                for column in (digests, anchors, places, sizes, turns):
                    column.append(None)
                continue
            digests.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest())
            found = []
            for seed, window in shapes:
                grams = gram_hashes(words, seed)
                at = syncmers(words, seed) if window is None else minimisers(grams, window)
                found.append((grams[at].view(np.int64), at.astype(np.int32), np.full(len(at), seed, np.int32)))
            for column, parts in zip((anchors, places, sizes), zip(*found)):
                column.append(np.concatenate(parts))
            turns.append(turns_of(anchors[-1]))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(lengths, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(anchors, pa.list_(pa.int64())),
                pa.array(places, pa.list_(pa.int32())),
                pa.array(sizes, pa.list_(pa.int32())),
                pa.array(turns, pa.list_(pa.int32())),
            ],
            ["doc_id", "n_words", "digest", "anchors", "places", "sizes", "turns"],
        )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(
        "doc_id is not null and text is not null"
    )
    profiles = stored(
        map_batches(narrow, work, "doc_id long, n_words long, digest binary, anchors array<long>, places array<int>, sizes array<int>, turns array<int>").filter("digest is not null"),
        "anchors",
    )
    classes = profiles.groupBy("digest").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies"))
    return profiles, stored(classes, "classes")


def turns_of(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each value."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(values) else np.zeros(0, np.int64)
    turns = np.empty(len(values), np.int32)
    turns[order] = np.arange(len(values)) - np.repeat(first, np.diff(np.concatenate((first, [len(values)]))))
    return turns


def heads(profiles: DataFrame, classes: DataFrame) -> DataFrame:
    """One document of each class."""
    firsts = classes.select(F.col("head").alias("doc_id"), "digest")
    return profiles.join(firsts, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])


def _context(words: np.ndarray, at: np.ndarray, step: int, length: int) -> np.ndarray:
    """(len(at), length) words that follow each position in direction ``step``; 0 beyond an end."""
    where = at[:, None] + step * np.arange(length)[None, :]
    inside = (where >= 0) & (where < len(words))
    short = (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return np.where(inside, short[np.clip(where, 0, max(0, len(words) - 1))], np.uint32(0))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the equal start of each pair of rows."""
    equal = (a == b) & (a != 0)
    return np.where(equal.all(axis=1), a.shape[1], equal.argmin(axis=1))


def _neighbours(frame: pd.DataFrame, seed: int, least: int, side: int) -> pd.DataFrame:
    """Spans of rows that match their nearest neighbour of another document, before or after them."""
    gram, doc, at = frame["gram"].to_numpy(), frame["doc_id"].to_numpy(), frame["at"].to_numpy()
    right = np.frombuffer(b"".join(frame["right"]), np.uint32).reshape(len(frame), side)
    left = np.frombuffer(b"".join(frame["left"]), np.uint32).reshape(len(frame), side)
    change = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1]))))
    run = np.repeat(np.arange(len(change)), np.diff(np.concatenate((change, [len(frame)]))))
    ends = np.concatenate((change[1:], [len(frame)]))
    found = []
    for other in (change[run] - 1, ends[run]):
        fine = (other >= 0) & (other < len(frame))
        rows, to = np.flatnonzero(fine), other[fine]
        same = gram[rows] == gram[to]
        rows, to = rows[same], to[same]
        if len(rows):
            after, before = _common(right[rows], right[to]), _common(left[rows], left[to])
            long = before + seed + after >= least
            rows, before, after = rows[long], before[long], after[long]
            found.append(pd.DataFrame({"doc_id": doc[rows], "start": at[rows] - before, "end": at[rows] + seed + after}))
    return pd.concat(found) if found else pd.DataFrame({"doc_id": [], "start": [], "end": []})


ROW = "gram long, doc_id long, at int, left binary, right binary"


def _compared(ordered: DataFrame, seed: int, least: int, side: int) -> DataFrame:
    """Spans from neighbours within each partition, and the rows at its ends (kind 1) for what crosses partitions.

    Between batches the last run of rows of one document and one row ahead of it are carried on.
    """
    ship(ordered.sparkSession)
    columns = ["kind", "gram", "doc_id", "at", "left", "right", "start", "end"]

    def spans(frame: pd.DataFrame) -> pd.DataFrame:
        out = _neighbours(frame, seed, least, side).astype({"doc_id": "int64", "start": "int64", "end": "int64"})
        return out.assign(kind=0, gram=0, at=0, left=None, right=None)[columns]

    def ends(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(kind=1, start=0, end=0)[columns]

    def edge_run(frame: pd.DataFrame, last: bool) -> pd.DataFrame:
        row = frame.iloc[-1 if last else 0]
        same = ((frame["gram"] == row["gram"]) & (frame["doc_id"] == row["doc_id"])).to_numpy()
        if same.all():
            return frame
        return frame.iloc[len(frame) - int(np.argmin(same[::-1])) :] if last else frame.iloc[: int(np.argmin(same))]

    def run(frames):
        held, first = None, True
        for frame in frames:
            if not len(frame):
                continue
            if first:
                yield ends(edge_run(frame, False))
                first = False
            whole = frame if held is None else pd.concat([held, frame], ignore_index=True)
            out = spans(whole)
            if len(out):
                yield out
            tail = edge_run(whole, True)
            ahead = whole.iloc[max(0, len(whole) - len(tail) - 1) : len(whole) - len(tail)]
            held = pd.concat([ahead, tail], ignore_index=True)
        if held is not None:
            yield ends(edge_run(held, True))

    schema = "kind int, gram long, doc_id long, at int, left binary, right binary, start long, end long"
    return ordered.mapInPandas(run, schema)


def _windows(kept: DataFrame, seed: int, least: int, side: int) -> DataFrame:
    """Spans of ``least`` words that hold a shared run and occur in two documents, for runs that more than two suffixes share.

    The run itself is equal by its hash, so a window is known by the run, its offset, and the words around.
    """
    many = kept.groupBy("gram").agg(F.count("*").alias("_n")).filter("_n > 2").select("gram")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        gram, doc, at = (batch.column(i).to_numpy() for i in range(3))
        left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(len(gram), side) for i in (3, 4))

        def prefixes(context: np.ndarray) -> list[np.ndarray | None]:
            known = [np.full(len(gram), 1, np.uint64)]
            for word in context.T:
                known.append(mixed(known[-1] ^ mixed(word.astype(np.uint64))) + np.uint64(1))
            return known

        before, after = prefixes(left), prefixes(right)
        keys, docs, starts = [], [], []
        for back in range(side + 1):
            inside = np.ones(len(gram), bool)
            if back:
                inside &= left[:, back - 1] != 0
            if back < side:
                inside &= right[:, side - back - 1] != 0
            key = mixed(mixed(gram.view(np.uint64) + np.uint64(back)) ^ mixed(before[back]) ^ (mixed(after[side - back]) << np.uint64(1)))
            keys.append(key[inside].view(np.int64))
            docs.append(doc[inside])
            starts.append(at[inside].astype(np.int64) - back)
        columns = [pa.array(np.concatenate(x)) for x in (keys, docs, starts)]
        return pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "start"])

    windows = stored(map_batches(kept.join(stored(many, "many"), "gram", "left_semi"), work, "key long, doc_id long, start long"), "windows")
    shared = windows.groupBy("key").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).filter("_a < _b").select("key")
    return windows.join(shared, "key", "left_semi").select("doc_id", "start", (F.col("start") + least).alias("end"))


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    """Overlapping or touching spans of one document as one."""
    start, end = frame["start"].to_numpy(), np.maximum.accumulate(frame["end"].to_numpy())
    new = np.concatenate(([True], start[1:] > end[:-1]))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(start)])) - 1
    return pd.DataFrame({"doc_id": frame["doc_id"].iloc[0], "start": start[first], "end": end[last]})


def repeated_passages(
    docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words, whole: passages that occur in another document too.

    One row per maximal span of covered words; ``whole`` marks documents that another one equals.
    """
    seed = max(1, min_words // 2)
    window = min_words - seed + 1
    side = min_words - seed
    profiles, classes = text_classes(docs, [(seed, window)], min_words, id_col, text_col)
    anchors = heads(profiles, classes).select("doc_id", F.explode("anchors").alias("gram"))
    shared = anchors.groupBy("gram").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).filter("_a < _b").select("gram")
    # a document's own grams: bounded by its length
    wanted = anchors.join(stored(shared, "grams"), "gram", "left_semi").groupBy("doc_id").agg(F.collect_set("gram").alias("grams"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = texts.join(wanted, "doc_id").select("doc_id", "text", "grams")

    def suffixes(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, data, grams in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), batch.column(2)):
            words = word_hashes(data or b"")
            if len(words) < min_words:
                continue
            own = gram_hashes(words, seed)
            at = minimisers(own, window)
            at = at[np.isin(own[at].view(np.int64), grams.values.to_numpy())]
            if len(at):
                right, left = _context(words, at + seed, 1, side), _context(words, at - 1, -1, side)
                out.append((own[at].view(np.int64), np.full(len(at), doc), at, left, right))
        if not out:
            return pa.RecordBatch.from_pylist([], pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("left", pa.binary()), ("right", pa.binary())]))
        gram, doc, at, left, right = (np.concatenate(x) for x in zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(gram), pa.array(doc, pa.int64()), pa.array(at.astype(np.int32)), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (left, right))],
            ["gram", "doc_id", "at", "left", "right"],
        )

    order = ["gram", "right", "doc_id", "at"]
    kept = stored(map_batches(held, suffixes, ROW), "suffixes")
    compared = stored(_compared(kept.repartitionByRange(*order).sortWithinPartitions(*order), seed, min_words, side), "compared")
    # the ends of partitions: two runs of each, compared once more in the same order
    edges = compared.filter("kind = 1").select("gram", "doc_id", "at", "left", "right")
    crossing = map_groups(edges, ["gram"], lambda f: _neighbours(f, seed, min_words, side), "doc_id long, start long, end long", order=order[1:])
    direct = compared.filter("kind = 0").select("doc_id", "start", "end")
    spans = direct.unionByName(crossing).unionByName(_windows(kept, seed, min_words, side)).distinct()
    merged = map_groups(spans, ["doc_id"], _merged, "doc_id long, start long, end long", order=["start", "end"])
    copies = profiles.join(classes.filter("copies > 1").select("digest"), "digest", "left_semi")
    whole = copies.select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"), F.lit(True).alias("whole")).distinct()
    parts = merged.join(whole.select("doc_id"), "doc_id", "left_anti").withColumn("whole", F.lit(False))
    return whole.unionByName(parts).select(
        "doc_id",
        F.col("start").alias("start_word"),
        F.col("end").alias("end_word"),
        (F.col("end") - F.col("start")).alias("n_words"),
        "whole",
    )
