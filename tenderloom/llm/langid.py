"""Language identification by rank-order profiles (operator 2).

A profile lists the most frequent character n-grams (one to three characters, words padded
by a blank on both sides) by rank. A text is compared with each language's profile by
out-of-place distance: for each of the text's n-grams the difference of its ranks, or the
profile length if the language's profile lacks it. The smallest distance wins, ties go to
the alphabetically first language.

Profiles are fitted on at most ``SAMPLE`` documents of each language, chosen by a hash of
id and text; they hold ``LENGTH`` n-grams each. Prediction reads the whole text of every row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderloom.llm.common import map_batches, stored

SAMPLE = 1000
LENGTH = 300
ORDERS = 3
UNDETERMINED = "und"
_BITS = 21  # a code point
_PIECE = 1 << 20


_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.bool_))
    return _LETTERS[0]


def _grams(text: str) -> np.ndarray:
    """Codes of all n-grams of letters, words padded by one blank (code 0)."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _is_letter()[points]
    padded = np.zeros(len(points) + 2, np.int64)
    padded[1:-1] = np.where(letter, points, 0)
    kept = np.ones(len(padded), bool)
    kept[1:] = (padded[1:] != 0) | (padded[:-1] != 0)  # a run of other characters is one blank
    line = padded[kept]
    parts = [line[line != 0]]
    codes = line
    for order in range(1, ORDERS):
        codes = (codes[:-1] << _BITS) | line[order:]
        inner = codes[line[1 : len(codes) + 1] != 0] if order == ORDERS - 1 else codes
        parts.append(inner | (1 << 63 - order) if order == 1 else inner)
    return np.concatenate(parts)


def ranked(text: str, length: int = LENGTH) -> np.ndarray:
    """The text's n-gram codes by falling count, ties by code; counts add up over pieces of the text."""
    if len(text) <= _PIECE:
        codes, counts = np.unique(_grams(text), return_counts=True)
    else:
        total: dict[int, int] = {}
        for i in range(0, len(text), _PIECE):
            for code, n in zip(*np.unique(_grams(text[i : i + _PIECE]), return_counts=True)):
                total[int(code)] = total.get(int(code), 0) + int(n)
        codes, counts = np.array(list(total)), np.array(list(total.values()))
    order = np.lexsort((codes, -counts))[:length]
    return codes[order]


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _uniform(*parts: Column) -> Column:
    """A number from 0 to 1 that only depends on ``parts``."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("langid"), *parts), 11) / F.lit(float(1 << 53))


def fit(docs: DataFrame, training: Column, id_col: str = "doc_id", sample: int = SAMPLE, length: int = LENGTH) -> DataFrame:
    """(lang, code, rank): profiles of all languages, at most ``length`` rows each.

    The rows with the smallest hashes of id and text are the sample. A table of language sizes, which
    Spark broadcasts while it is small, drops most other rows before anything is shuffled. Counts of
    the sampled texts are summed in the tasks first. A language of fewer documents is used whole.
    Rows equal in id and text share a hash, so a language of more than twice ``sample`` rows that
    are all equal has no profile.
    """
    labelled = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", F.col(id_col).alias("_id"), "text", _uniform(F.col(id_col), F.col("text")).alias("_at")
    )
    sizes = stored(labelled.groupBy("lang").agg(F.count("*").alias("_n")), "languages")
    # twice the sample in expectation; the exact cut then sees a few thousand rows of each language
    likely = labelled.join(sizes, "lang").filter(F.col("_at") * F.col("_n") <= 2 * sample)
    place = Window.partitionBy("lang").orderBy("_at", "_id", "text")
    texts = likely.withColumn("_row", F.row_number().over(place)).filter(F.col("_row") <= sample).select("lang", "text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        frames = []
        for lang in sorted(set(langs)):
            own = [_grams(t) for x, t in zip(langs, texts) if x == lang and _has_letter(t)]
            if own:
                codes, counts = np.unique(np.concatenate(own), return_counts=True)
                frames.append(pd.DataFrame({"lang": lang, "code": codes, "n": counts}))
        found = pd.concat(frames) if frames else pd.DataFrame({"lang": [], "code": [], "n": []})
        schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])
        return pa.RecordBatch.from_pandas(found, schema, preserve_index=False)

    counts = map_batches(texts, count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= length).select("lang", "code", "rank")


class Profiles:
    """All languages' ranks, found by code."""

    def __init__(self, rows: list[tuple[str, int, int]], length: int = LENGTH) -> None:
        self.langs = sorted({r[0] for r in rows})
        self.length = length
        codes = np.array(sorted({r[1] for r in rows}), np.int64)
        place = {int(c): i for i, c in enumerate(codes)}
        at = {lang: i for i, lang in enumerate(self.langs)}
        # a row more for n-grams that no profile has; 0: not in this language's profile
        self.ranks = np.zeros((len(codes) + 1, len(self.langs)), np.int64)
        for lang, code, rank in rows:
            self.ranks[place[code], at[lang]] = rank
        self.codes = codes

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: one minus the winner's distance over the largest possible one."""
        if not self.langs or not _has_letter(text):
            return UNDETERMINED, 0.0
        own = ranked(text, self.length)
        where = np.searchsorted(self.codes, own)
        where[where == len(self.codes)] = 0
        missing = self.codes[where] != own
        where[missing] = len(self.codes)
        theirs = self.ranks[where]
        mine = np.arange(1, len(own) + 1)[:, None]
        apart = np.where(theirs == 0, self.length, np.abs(theirs - mine)).sum(axis=0)
        best = int(np.argmin(apart))
        return self.langs[best], float(1.0 - apart[best] / (self.length * len(own)))


def identify(docs: DataFrame, profiles: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` plus lang_pred and score; rows, order of columns and extra columns are kept.

    ``profiles`` holds at most languages x ``length`` rows, so it goes to every task. A text that
    is null or has no letter gets ``und`` and 0; so does every text if nothing was learned.
    Columns of these names in the input are replaced.
    """
    rows = [tuple(r) for r in profiles.select("lang", "code", "rank").collect()]
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index("text")
    model: list[Profiles] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not model:
            model.append(Profiles(rows, length))
        found = [model[0].predict(t) for t in batch.column(at).to_pylist()]
        langs, scores = zip(*found)
        added = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
        return pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "lang_pred", "score"])

    frame = docs.select(*kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return map_batches(frame, work, f"{fields}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """The evaluation third: crc32 of the id as text leaves 1 modulo 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, learned from the rows that are not held out."""
    profiles = stored(fit(docs, ~held_out()), "profiles")
    narrow = docs.select("doc_id", "text")
    return identify(narrow, profiles).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )


def _lettered(docs: DataFrame) -> DataFrame:
    """The rows whose text has a letter."""
    at = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([_has_letter(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, work, fields)


def with_language(docs: DataFrame) -> DataFrame:
    """Pipeline stage: drop documents without a letter and give the predicted language to rows whose lang is null.

    Profiles come from the rows that are not held out, or from all labelled rows if those have no label.
    Where no row has one, or a text shares no n-gram with a profile, lang stays null.
    """
    profiles = stored(fit(docs, ~held_out()), "profiles")
    if profiles.isEmpty():
        profiles = stored(fit(docs, F.lit(True)), "profiles")
    if profiles.isEmpty():
        return _lettered(docs)
    known = identify(docs, profiles).filter(F.col("lang_pred") != UNDETERMINED)
    lang = F.coalesce("lang", F.when(F.col("score") > 0, F.col("lang_pred"))).alias("lang")
    return known.select(*[lang if c == "lang" else F.col(c) for c in docs.columns])
