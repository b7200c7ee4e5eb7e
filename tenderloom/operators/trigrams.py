"""Substring search through trigram postings instead of a scan of every text.

The searched rows lie in a table sorted by block, a block being ``BLOCK_ROWS`` consecutive ids, in folders of
``FOLDER_BLOCKS`` blocks. Postings name per field and trigram the blocks in which it occurs. A needle's
trigrams must all occur in a block that holds it, so their posting lists are intersected; only the folders and
blocks that are left are read, and every row is tested with the needle itself. Trigrams fold A-Z as the test
does, and nothing else. A posting holds a trigram as one number, its three code points side by side.

A needle under three characters has no trigram: it is tested on every row. New rows are appended with their
own postings; a block that gets rows twice is in both.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tenderloom.shared import ship, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_ROWS = 16
FOLDER_BLOCKS = 256
BUCKETS = 64
GRAM = 3
POINT_BITS = 21
WITHIN_BITS = 20


def folded(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, folded, in one pass; none for texts under three characters."""
    return F.array_distinct(F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def needle_grams(needle: str) -> list[str]:
    low = needle.translate(str.maketrans(UPPER, LOWER))
    return sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})


def gram_code(gram: str) -> int:
    """The code points of a trigram side by side in 63 bits."""
    return reduce(lambda code, c: code << POINT_BITS | ord(c), gram, 0)


def gram_codes(texts: list[str | None]) -> np.ndarray:
    """The distinct trigrams of some texts, folded, as numbers; none reaches from one text into the next."""
    parts = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts if t is not None and len(t) >= GRAM]
    if not parts:
        return np.zeros(0, np.int64)
    points = np.concatenate(parts).astype(np.int64)
    points[(points >= ord("A")) & (points <= ord("Z"))] += ord("a") - ord("A")
    codes = points[:-2] << 2 * POINT_BITS | points[1:-1] << POINT_BITS | points[2:]
    ends = np.cumsum([len(p) for p in parts])[:-1]
    return np.unique(np.delete(codes, np.concatenate([ends - 2, ends - 1])))


def block_grams(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(block, field, gram) that occur in rows of block and fields; once per batch of rows that holds a part of the block."""
    names = pa.array(fields, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0).to_numpy()
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], block[order][1:] != block[order][:-1])))
            for f in range(len(fields)):
                texts = batch.column(f + 1).take(pa.array(order)).to_pylist()
                grams_of = [gram_codes(texts[a:b]) for a, b in zip(cuts, [*cuts[1:], len(texts)])]
                sizes = [len(g) for g in grams_of]
                blocks = np.repeat(block[order][cuts], sizes)
                field = names.take(pa.array(np.full(len(blocks), f)))
                yield pa.RecordBatch.from_arrays([pa.array(blocks), field, pa.array(np.concatenate(grams_of))], ["block", "field", "gram"])

    ship(rows.sparkSession)
    return rows.select("block", *fields).mapInArrow(run, "block long, field string, gram long")


def bucket(field: Column, gram: Column) -> Column:
    return F.pmod(F.xxhash64(field, gram), F.lit(BUCKETS)).cast("int")


def posting_task(bucket: Column, field: Column, gram: Column, tasks: int) -> Column:
    """One of ``tasks`` even stretches of all buckets, one after the other; further bits of the hash tell where in its bucket a trigram stands.

    Hashes are even, so the stretches need no sample, which would take every text apart a second time.
    """
    within = F.pmod(F.shiftright(F.xxhash64(field, gram), 32), F.lit(1 << WITHIN_BITS))
    place = bucket.cast("long") * (1 << WITHIN_BITS) + within
    return F.floor(place * tasks / (BUCKETS << WITHIN_BITS)).cast("int")


class TrigramIndex:
    """Rows with an ``id`` and the postings of some of their text fields, under one path."""

    def __init__(
        self, spark: SparkSession, path: str, fields: tuple[str, ...], block_rows: int = BLOCK_ROWS, folder_blocks: int = FOLDER_BLOCKS
    ) -> None:
        self.spark, self.path, self.fields = spark, path.rstrip("/"), fields
        self.schema = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(f, T.StringType()) for f in fields]])
        self.block_rows, self.folder_blocks = block_rows, folder_blocks

    def append(self, rows: DataFrame) -> None:
        """Add rows, whose ids are not negative. One shuffle for the rows, one for the postings, none of them by a sample."""
        self.schema = rows.schema
        block = F.floor(F.col("id") / self.block_rows).cast("long")
        placed = rows.withColumn("block", block).withColumn("folder", F.floor(F.col("block") / self.folder_blocks).cast("long"))
        # a folder holds a fixed number of ids
        ordered = placed.repartition("folder").sortWithinPartitions("folder", "block", "id")
        ordered.write.partitionBy("folder").mode("append").parquet(f"{self.path}/rows")
        # a block that came in several batches has a posting for each
        postings = block_grams(rows.withColumn("block", block), self.fields).withColumn("bucket", bucket(F.col("field"), F.col("gram")))
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = postings.repartitionById(tasks, posting_task(F.col("bucket"), F.col("field"), F.col("gram"), tasks))
        sorted_postings = dealt.sortWithinPartitions("bucket", "field", "gram", "block")
        sorted_postings.write.partitionBy("bucket").mode("append").parquet(f"{self.path}/postings")

    def _read(self, part: str, empty: str | T.StructType) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.path}/{part}")
        except AnalysisException as error:  # nothing appended yet, or only empty tables
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], empty)

    def rows(self) -> DataFrame:
        return self._read("rows", T.StructType([*self.schema.fields, T.StructField("block", T.LongType()), T.StructField("folder", T.LongType())]))

    def blocks(self, needle: str, fields: tuple[str, ...]) -> DataFrame | None:
        """(block) that hold all trigrams of the needle in one of the fields; None if the needle has none."""
        wanted = needle_grams(needle)
        if not wanted:
            return None
        wanted = [gram_code(g) for g in wanted]
        keys = [(f, g) for f in fields for g in wanted]
        asked = self.spark.createDataFrame(keys, "field string, gram long").select(
            bucket(F.col("field"), F.col("gram")).alias("bucket")
        )
        buckets = [r["bucket"] for r in asked.distinct().collect()]  # at most BUCKETS
        postings = self._read("postings", "block long, field string, gram long, bucket int")
        held = postings.filter(F.col("bucket").isin(buckets) & F.col("field").isin(*fields) & F.col("gram").isin(wanted))
        counted = held.groupBy("block", "field").agg(F.count_distinct("gram").alias("n"))
        return counted.filter(F.col("n") == len(wanted)).select("block").distinct()

    def candidates(self, needles: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
        """Rows of the blocks that may hold every needle in one of its fields."""
        lists = [b for b in (self.blocks(n, f) for n, f in needles) if b is not None]
        rows = self.rows()
        if not lists:
            return rows.drop("block", "folder")
        both = reduce(lambda a, b: a.join(b, "block", "left_semi"), lists)
        found = written(both.withColumn("folder", F.floor(F.col("block") / self.folder_blocks).cast("long")), "blocks")
        # names of folders, as the file listing has them: the scan then opens no other
        folders = [r["folder"] for r in found.select("folder").distinct().collect()]
        ends = found.agg(F.min("block").alias("low"), F.max("block").alias("high")).first()
        low, high = (0, -1) if ends["low"] is None else (ends["low"], ends["high"])
        near = rows.filter(F.col("folder").isin(folders) & F.col("block").between(low, high))
        return near.join(found.select("block"), "block", "left_semi").drop("block", "folder")
