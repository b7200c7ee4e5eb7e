"""Grouping spelling variants by dense prefix-suffix tiling (operator 12).

Words are counted over all texts. Two words are near if one inserted, deleted or replaced code
point makes one of the other. For words whose longer one has L code points, the place of the
edit lies in one of three segments of [0, L), and what stands before and behind that segment is
the same in both; so words meet only where their length class, segment and the text around it are
equal. A group that is still large has its segment halved, until one place is left: then it
holds at most one word of L - 1 code points and one of L for every letter of the alphabet. No
group is unbounded, and no pair is left out.

The words of the groups lie in rows of a padded code-point matrix, once from the front and once
from the back. Blocks of rows are compared with blocks of rows: the lengths of the common
prefix and of the common suffix of all pairs come from two dense comparisons, and a pair is near
if both together reach the longer length minus one. The pair counts in the one segment that its
common prefix ends in, so no pair is found twice.

A word's form is its near word with the most occurrences, if it has enough more of them; forms
are followed to the last one by joins of the table of forms with itself, which double the
step each time. Since occurrences grow along the way, there are no cycles.

Null texts and texts without a long word add nothing. Repeated rows count each time. A null id reads
as an empty one. Tables without words give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tenderloom.llm.common import ship, stored

LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH = 7
LEAST_COUNT = 2
SLIP = 31
DOMINANCE = 10
SEGMENTS = 3
GROUP = 192
ROWS = 64
CELLS = 1 << 19


def slipped(doc_id: Column, run: Column, slip: int) -> Column:
    """The run, without one code point where a hash of document and run is a multiple of ``slip``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(h, F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % slip == 0, shorter).otherwise(run)


def word_counts(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int = SLIP,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(word, n): words of at least ``least_length`` code points that occur often enough.

    Runs shorter than that never give such a word and are not taken out of the text.
    """
    lowered = F.translate(F.col(text_col), UPPER, LOWER)
    runs = F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    found = docs.select(F.col(id_col).alias("_doc"), F.explode(runs).alias("_run"))
    words = found.select(slipped(F.col("_doc"), F.col("_run"), slip).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


# ---------------------------------------------------------------- groups


def _around(word: Column, longer: Column, low: Column, high: Column) -> Column:
    """A hash of the word's length class, its segment, and the text before and behind the segment."""
    behind = longer - high
    ends = F.substring(word, F.length(word) - behind + 1, behind)
    return F.xxhash64(longer, low, F.substring(word, F.lit(1), low), F.when(behind > 0, ends).otherwise(F.lit("")))


def _placed(rows: DataFrame) -> DataFrame:
    key = _around(F.col("word"), F.col("longer"), F.col("low"), F.col("high"))
    return rows.select("word", "n", "longer", "low", "high", key.alias("key"))


def segments(words: DataFrame, parts: int = SEGMENTS) -> DataFrame:
    """(word, n, longer, low, high, key): every word in its own length class and the next one, per segment."""
    length = F.length("word")
    classes = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("longer"))
    ends = F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)),
        lambda i: F.struct(
            F.floor(F.col("longer") * i / parts).cast("int").alias("low"), F.floor(F.col("longer") * (i + 1) / parts).cast("int").alias("high")
        ),
    )
    cut = classes.select("word", "n", "longer", F.explode(ends).alias("_s")).select("word", "n", "longer", "_s.low", "_s.high")
    return _placed(cut.filter("high > low"))


def bounded_groups(words: DataFrame, most: int = GROUP) -> DataFrame:
    """The rows of all groups of two or more words; groups of more than ``most`` words have their segments halved.

    Halving ends with the segment's length, so there are about log2 of the longest word's length rounds.
    """
    done, rows = [], stored(segments(words), "segments")
    while True:
        sizes = stored(rows.groupBy("key").agg(F.count("*").alias("_size")).filter("_size > 1"), "group-sizes")
        held = rows.join(sizes, "key")
        large = (F.col("_size") > most) & (F.col("high") - F.col("low") > 1)
        done.append(held.filter(~large).drop("_size"))
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(
            F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high"))
        )
        if sizes.filter(F.col("_size") > most).isEmpty():
            break
        cut = held.filter(large).select("word", "n", "longer", F.explode(halves).alias("_s"))
        rows = stored(_placed(cut.select("word", "n", "longer", "_s.low", "_s.high")), "segments")
        if rows.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


# ---------------------------------------------------------------- tiles


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded matrices of the words from the front and from the back, and their lengths."""
    lengths = np.array([len(w) for w in words])
    width = int(lengths.max(initial=1))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    # words only hold letters below U+0100, so a code point is a byte; other alphabets keep four
    kind = np.uint8 if not len(flat) or flat.max() < 256 else np.uint32
    front, back = np.zeros((len(words), width), kind), np.zeros((len(words), width), kind)
    inside = np.arange(width) < lengths[:, None]
    front[inside] = flat
    back[:, ::-1][np.arange(width) >= width - lengths[:, None]] = flat
    return front, back, lengths


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of every row of ``a`` with every row of ``b``; padding ends it against a longer row."""
    differ = a[:, None, :] != b[None, :, :]
    first = differ.argmax(axis=2)
    return np.where(differ.any(axis=2), first, a.shape[1])


def near_pairs(words: list[str], group: np.ndarray, longer: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j), i < j, of near words of the same group whose edit lies in the group's segment.

    Rows of a group stand together. A block of rows meets itself and the blocks that its last group reaches into.
    """
    lefts, rights, at, total = [], [], 0, len(words)
    ends = np.searchsorted(group, group, side="right") if total else group  # group numbers rise
    while at < total:
        widest = int(longer[at : at + ROWS].max())
        rows = max(1, min(ROWS, int(math.sqrt(CELLS / widest))))
        stop = min(total, at + rows)
        reach = int(ends[stop - 1])
        for other in range(at, max(reach, stop), rows):
            last = min(other + rows, max(reach, stop))
            i, j = np.arange(at, stop), np.arange(other, last)
            together = (group[i][:, None] == group[j][None, :]) & (i[:, None] < j[None, :])
            if not together.any():
                continue
            front, back, lengths = code_points(words[at:stop] + words[other:last])
            n = stop - at
            prefix, suffix = common(front[:n], front[n:]), common(back[:n], back[n:])
            most = np.maximum.outer(lengths[:n], lengths[n:])
            apart = np.abs(np.subtract.outer(lengths[:n], lengths[n:])) <= 1
            # in the class of the next length only pairs of unequal length count, equal ones have their own class
            found = together & apart & (most == longer[i][:, None]) & (prefix + suffix >= most - 1)
            found &= (prefix >= low[i][:, None]) & (prefix < high[i][:, None])
            x, y = np.nonzero(found)
            lefts.append(x + at)
            rights.append(y + other)
        at = stop
    if not lefts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(lefts), np.concatenate(rights)


def _tiled(groups: DataFrame) -> DataFrame:
    """(word, n_near, best): per word and task what its near words of one group add up to."""

    def finish(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        whole = pa.Table.from_batches(held)
        words, n = whole.column(0).to_pylist(), whole.column(1).to_numpy()
        key, longer, low, high = (whole.column(c).to_numpy() for c in ("key", "longer", "low", "high"))
        group = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
        i, j = near_pairs(words, group, longer, low, high)
        if not len(i):
            return None
        at, to = np.concatenate([i, j]), np.concatenate([j, i])
        order = np.argsort(at, kind="stable")
        at, to = at[order], to[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at))
        best = [min(to[a:b].tolist(), key=lambda t: (-n[t], words[t])) if b - a > 1 else int(to[a]) for a, b in zip(first, last)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([words[a] for a in at[first]], pa.string()),
                pa.array(last - first, pa.int64()),
                pa.array([-int(n[b]) for b in best], pa.int64()),
                pa.array([words[b] for b in best], pa.string()),
            ],
            ["word", "n_near", "less", "near"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last group of a batch may go on in the next one; groups are bounded
            key = batch.column("key").to_numpy()
            if held and key[0] != held[-1].column("key")[held[-1].num_rows - 1].as_py():
                if (done := finish(held)) is not None:
                    yield done
                held = []
            cut = int(np.searchsorted(key, key[-1]))
            held.append(batch.slice(0, cut) if cut else batch)
            if cut:
                if (done := finish(held)) is not None:
                    yield done
                held = [batch.slice(cut)]
        if held and (done := finish(held)) is not None:
            yield done

    ship(groups.sparkSession)
    dealt = groups.repartition("key").sortWithinPartitions("key").select("word", "n", "longer", "low", "high", "key")
    return dealt.mapInArrow(run, "word string, n_near long, less long, near string")


# ---------------------------------------------------------------- forms


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of every chain of (word, form)."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stored(at.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        at = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            return at


def spelling_variants(
    docs: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    slip: int = SLIP,
    dominance: int = DOMINANCE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if that n is at least
    ``dominance`` times the word's, ``root`` the last form along the way, or the word.
    """
    words = stored(word_counts(docs, least_length, least_count, slip, id_col, text_col), "words")
    found = _tiled(bounded_groups(words))
    # a word has a row per group it has near words in
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("_best"))
    most = -F.col("_best.less")
    has = F.coalesce(most >= dominance * F.col("n"), F.lit(False))
    judged = words.join(near, "word", "left").select(
        "word",
        F.when(has, F.col("_best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(has, most).alias("form_n"),
    )
    rows = stored(judged, "judged")
    roots = _roots(rows.filter("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
