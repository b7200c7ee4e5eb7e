"""Shared parts of the training-data operators: shipping, table access, hashing of words in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tenderloom.shared import new_path, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back; cuts lineage, survives lost executors.

    Nothing reads the write's own shuffles again, so Spark removes their files when it ends.
    """
    spark = df.sparkSession
    path = new_path(spark, f"llm-{name}")
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` over every Arrow batch; a batch is bounded by Spark's records and bytes per batch."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return df.mapInArrow(run, schema)


def map_groups(
    df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, order: list[str] = ()
) -> DataFrame:
    """``work`` over each group of ``keys``; the caller sees to it that groups are bounded.

    Cheaper than one Python call per group from Spark: rows are sorted by key in
    each partition, and groups are cut from the Arrow batches as they pass.
    """
    ship(df.sparkSession)
    columns = [f.split()[0] for f in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def starts(frame: pd.DataFrame) -> np.ndarray:
            change = np.zeros(len(frame), bool)
            change[0] = True
            for key in keys:
                values = frame[key].to_numpy()
                change[1:] |= values[1:] != values[:-1]
            return np.flatnonzero(change)

        def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
            return all(a[k].iloc[-1] == b[k].iloc[0] for k in keys)

        def finish() -> Iterator[pd.DataFrame]:
            if held:
                whole = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held.clear()
                out = work(whole)
                if out is not None and len(out):
                    yield out[columns]

        for frame in frames:
            if not len(frame):
                continue
            cuts = [*starts(frame), len(frame)]
            done: list[pd.DataFrame] = []
            for first, last in zip(cuts[:-1], cuts[1:]):
                part = frame.iloc[first:last]
                if held and not same(held[-1], part):
                    done.extend(finish())
                held.append(part)
            if done:
                yield pd.concat(done, ignore_index=True)
        yield from finish()

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, schema)


# ---------------------------------------------------------------- numpy hashing

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """Powers of an odd base modulo 2^64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            size = max(1 << 16, 1 << int(n - 1).bit_length())
            powers = np.full(size, self.base, np.uint64)
            powers[0] = 1
            self.values = np.cumprod(powers, dtype=np.uint64)
        return self.values[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_BASE_INVERSE)
_SEQ_BASE = 0xD1342543DE82EF95
_SEQ_UP, _SEQ_DOWN = _Powers(_SEQ_BASE), _Powers(pow(_SEQ_BASE, -1, 1 << 64))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte array with A-Z lower-cased, and the start and end of every word in it.

    A word is a run of bytes other than space and 0x09 to 0x0D.
    """
    raw = np.frombuffer(data.lower(), np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    step = np.diff(inside)
    return raw, np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a UTF-8 text, in order, from one cumulative sum."""
    raw, first, last = word_spans(data)
    return hashed_spans(raw, first, last)


def hashed_spans(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    if not len(first):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _UP.upto(len(raw)), out=total[1:])
    return mixed((total[last] - total[first]) * _DOWN.upto(len(raw))[first] + (last - first).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _SEQ_UP.upto(len(words)), out=total[1:])
    return mixed((total[k:] - total[:-k]) * _SEQ_DOWN.upto(n))


def shingle_set(data: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes: runs of ``k`` words, or the whole sequence if it is shorter."""
    words = word_hashes(data) if data else np.zeros(0, np.uint64)
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(k, len(words))))


def minimisers(values: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the smallest value of some ``window`` consecutive values (first of equals).

    Two sequences that share ``window`` consecutive values select a common one among them.
    """
    n = len(values)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= window:
        return np.array([int(np.argmin(values))])
    blocks = -(-n // window)
    padded = np.full(blocks * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    smallest = np.minimum(behind[: n - window + 1], ahead[window - 1 : n])
    # the first position at or after each window's start that holds its minimum
    moved = (smallest[1:] != smallest[:-1]) | (values[: len(smallest) - 1] == smallest[1:])
    order = np.flatnonzero(np.concatenate(([True], moved)))
    windows = np.lib.stride_tricks.sliding_window_view(values, window)[order]
    return np.unique(order + windows.argmin(axis=1))


def syncmers(words: np.ndarray, k: int, s: int = 2) -> np.ndarray:
    """Positions of runs of ``k`` words whose smallest run of ``s`` words is the first or the last one in it.

    The choice only depends on the run itself, so edits next to it don't change it. Of ``k - s``
    consecutive runs one at least is selected.
    """
    if len(words) < k:
        return np.zeros(0, np.int64)
    inner = gram_hashes(words, s)
    n = len(words) - k + 1
    first, last = inner[:n], inner[k - s :]
    smallest = inner[1 : n + 1]
    for i in range(2, k - s):
        smallest = np.minimum(smallest, inner[i : n + i])
    # the first of equals counts
    return np.flatnonzero(((first <= smallest) & (first <= last)) | ((last < smallest) & (last < first)))


def texts_as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
