"""The stored registry: append-only batches made visible by their run record.

A batch adds its new rows, the fingerprints it saw again and one run record, all in
folders of its own attempt, and last of all a file named after the batch number that
names the attempt. That file is written under another name and renamed without replacing, so it is whole
whenever it exists, and of two writers that started from the same log one publishes and the other fails without
losing anything. Readers only take published attempts: an interrupted batch is never visible.

Rows lie in buckets by the first digits of their fingerprint, and every bucket of a batch has a Bloom filter
over its fingerprints. A batch asks the filters of the buckets its own fingerprints fall into, and reads the fingerprint
column of the files that may hold one of them, so its cost follows its own size and not the table's.
A batch is written as its last join leaves it, a file per task and bucket, which spares a shuffle of its rows.
``compact`` merges the batches so far into one set of files per bucket, in the same way invisible until it
is published; stored rows are never rewritten in place.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tenderloom.functions.dates import utc_now
from tenderloom.operators.dedupe import HASH, first_wins, known_hashes, numbered
from tenderloom.schema import RUN_SCHEMA, TENDER_COLUMNS, canonical
from tenderloom.shared import written

ROWS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField(HASH, T.StringType()),
        *[T.StructField(c, T.StringType()) for c in TENDER_COLUMNS],
        T.StructField("first_seen_at", T.TimestampNTZType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("attempt", T.StringType()),
        T.StructField("bucket", T.StringType()),
    ]
)
BLOOM_SCHEMA = T.StructType(
    [
        T.StructField("segments", T.LongType()),
        T.StructField("segment", T.LongType()),
        T.StructField("bits", T.BinaryType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("attempt", T.StringType()),
        T.StructField("bucket", T.StringType()),
    ]
)
SEEN_SCHEMA = T.StructType(
    [
        T.StructField(HASH, T.StringType()),
        T.StructField("seen_at", T.TimestampNTZType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("attempt", T.StringType()),
    ]
)
LOGGED_SCHEMA = T.StructType([*RUN_SCHEMA.fields, T.StructField("attempt", T.StringType())])


class ConcurrentBatchError(RuntimeError):
    """Another writer has published a batch since this one read the log; append again."""


# Bits of one segment of a filter, bits per fingerprint, and probes: about one false hit in a hundred.
SEGMENT = 1 << 15
BITS_PER_KEY = 10
PROBES = 4
ROWS_PER_FILE = 1 << 20


def _probes(segments: Column) -> Column:
    """The places of a fingerprint in a filter of so many segments."""
    return F.array(*[F.pmod(F.xxhash64(F.col(HASH), F.lit(i)), segments * SEGMENT) for i in range(PROBES)])


def _bit(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1


class TenderStore:
    """The stored table under ``path``; ``prefix`` is the number of hexadecimal digits that name a bucket."""

    def __init__(self, spark: SparkSession, path: str, prefix: int = 1):
        self.spark = spark
        self.path = path.rstrip("/")
        self.prefix = prefix

    def _read(self, part: str, schema: T.StructType) -> DataFrame:
        return self._or_empty(lambda: self.spark.read.schema(schema).parquet(f"{self.path}/{part}"), schema)

    def _or_empty(self, read: Callable[[], DataFrame], schema: T.StructType) -> DataFrame:
        try:
            return read()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, part: str, batch_id: int, attempt: str, *by: str) -> None:
        df.write.partitionBy(*by).parquet(f"{self.path}/{part}/batch_id={batch_id}/attempt={attempt}")

    def _bucket(self) -> Column:
        return F.substring(HASH, 1, self.prefix).alias("bucket")

    def _dealt(self, rows: DataFrame, count: int) -> DataFrame:
        """Rows shuffled so that every bucket has as few files as its size allows."""
        files = max(1, -(-count // (ROWS_PER_FILE * 16**self.prefix)))
        return rows.repartition(self._bucket(), F.pmod(F.xxhash64(HASH), F.lit(files)))

    def _write_rows(self, rows: DataFrame, batch_id: int, attempt: str, count: int) -> None:
        """Rows in files per bucket, and a Bloom filter per bucket."""
        self._write(rows.withColumn("bucket", self._bucket()), "rows", batch_id, attempt, "bucket")
        if not count:
            return
        keys = self.spark.read.schema(T.StructType([f for f in ROWS_SCHEMA if f.name in (HASH, "bucket")])).parquet(
            f"{self.path}/rows/batch_id={batch_id}/attempt={attempt}"
        )
        sizes = keys.groupBy("bucket").agg(F.ceil(F.count("*") * BITS_PER_KEY / SEGMENT).alias("segments"))
        places = keys.join(sizes, "bucket").select("bucket", "segments", F.explode(_probes(F.col("segments"))).alias("place"))
        bits = places.groupBy("bucket", "segments", F.floor(F.col("place") / SEGMENT).alias("segment")).agg(
            F.bitmap_construct_agg(F.col("place") % SEGMENT).alias("bits")
        )
        self._write(bits, "blooms", batch_id, attempt, "bucket")

    def _publish(self, folder: str, name: str, attempt: str) -> None:
        """Make an attempt the one of its name, unless another one is. An empty file, as an
        interrupted writer of earlier versions left it, counts as none."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.path}/{folder}/{name}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if files.exists(path) and files.getFileStatus(path).getLen() == 0:
            files.delete(path, False)
        draft = hadoop.Path(f"{self.path}/{folder}/_{name}-{attempt}")
        out = files.create(draft, False)
        out.writeBytes(attempt)
        out.close()
        context = hadoop.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
        never_replace = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            context.rename(draft, path, never_replace)
        except Py4JJavaError as error:
            files.delete(draft, False)
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            raise ConcurrentBatchError(f"{folder} {name} was published by another writer") from error

    def _named(self, folder: str) -> DataFrame:
        """(number, attempt): the published names of a folder, one short row each."""
        schema = T.StructType([T.StructField("value", T.StringType())])
        named = T.StructType([*schema.fields, T.StructField("name", T.StringType())])
        found = self._or_empty(lambda: self.spark.read.text(f"{self.path}/{folder}").select("value", F.col("_metadata.file_name").alias("name")), named)
        return found.select(F.col("name").cast("long").alias("number"), F.col("value").alias("attempt"))

    def _attempts(self) -> DataFrame:
        """The attempts that hold the table: the last compaction, and the batches after it."""
        last = self._named("compacted").agg(F.max(F.struct("number", "attempt")).alias("m")).first()["m"]
        batches = self._named("published")
        if last is None:
            return batches.select("attempt")
        merged = self.spark.createDataFrame([(last["attempt"],)], "attempt string")
        return batches.filter(F.col("number") > last["number"]).select("attempt").unionByName(merged)

    def runs(self) -> DataFrame:
        """M3: the run log, one row per published batch."""
        return self._read("runs", LOGGED_SCHEMA).join(self._named("published"), "attempt", "left_semi").select(*RUN_SCHEMA.names)

    def _published(self, part: str, schema: T.StructType) -> DataFrame:
        return self._read(part, schema).join(self._attempts(), "attempt", "left_semi")

    def rows(self) -> DataFrame:
        """Published rows without the time they were last seen."""
        return self._published("rows", ROWS_SCHEMA).drop("batch_id", "attempt", "bucket")

    def holding(self, keys: DataFrame) -> list[str]:
        """Folders of the stored buckets that may hold one of the fingerprints, by their filters.

        Each fingerprint meets the filters of its bucket, one row per batch since the last compaction. What is
        collected are names of folders, as a file listing has them.
        """
        filters = self._published("blooms", BLOOM_SCHEMA).withColumnRenamed("bucket", "b")
        wanted = keys.select(HASH, F.substring(HASH, 1, self.prefix).alias("b"))
        sizes = filters.select("b", "batch_id", "attempt", "segments").distinct()
        asked = wanted.join(sizes, "b").withColumn("place", F.explode(_probes(F.col("segments"))))
        asked = asked.withColumn("segment", F.floor(F.col("place") / SEGMENT)).withColumn("at", F.col("place") % SEGMENT)
        met = asked.join(filters, ["b", "batch_id", "attempt", "segment"]).groupBy(HASH, "b", "batch_id", "attempt")
        # two probes may fall on one place; every probe has to find its bit
        hits = met.agg(F.count_if(_bit(F.col("bits"), F.col("at"))).alias("hits")).filter(F.col("hits") == PROBES)
        found = hits.select("batch_id", "attempt", "b").distinct().collect()
        return sorted(f"{self.path}/rows/batch_id={r['batch_id']}/attempt={r['attempt']}/bucket={r['b']}" for r in found)

    def known(self, staged: DataFrame) -> DataFrame:
        """Fingerprints of ``staged`` that are stored already; only files that may hold one are read."""
        folders = self.holding(staged)
        if not folders:
            return staged.select(HASH).limit(0)
        stored = self.spark.read.schema(ROWS_SCHEMA).option("basePath", f"{self.path}/rows").parquet(*folders)
        return known_hashes(stored, staged)

    def compact(self) -> None:
        """Merge all batches so far, rows and times seen, into one attempt with one filter per bucket.

        A batch that is published meanwhile is not part of it and stays as it is. The folders of what was merged are left
        to the cluster's retention, so readers that have begun can finish.
        """
        last = self._named("published").agg(F.max("number")).first()[0]
        if last is None or self._named("compacted").filter(F.col("number") >= last).first():
            return
        attempt = uuid.uuid4().hex
        part = lambda name, schema: self._published(name, schema).filter(F.col("batch_id") <= last)
        rows = part("rows", ROWS_SCHEMA).drop("batch_id", "attempt", "bucket")
        count = rows.count()
        self._write_rows(self._dealt(rows, count), last, attempt, count)
        seen = part("seen", SEEN_SCHEMA).groupBy(HASH).agg(F.max("seen_at").alias("seen_at"))
        self._write(seen, "seen", last, attempt)
        self._publish("compacted", str(last), attempt)

    def tenders(self) -> DataFrame:
        """The table with both audit times. Queries that leave out ``last_seen_at``
        are planned without the join, because fingerprints are unique on its right side."""
        seen = self._published("seen", SEEN_SCHEMA).groupBy(HASH).agg(F.max("seen_at").alias("seen_at"))
        last = F.coalesce("seen_at", "first_seen_at").alias("last_seen_at")
        return self.rows().join(seen, HASH, "left").select("id", HASH, *TENDER_COLUMNS, "first_seen_at", last)

    def append(
        self,
        batch: DataFrame,
        now: datetime,
        *,
        replay_key: str | None = None,
        mode: str = "bootstrap",
        target_year: str = "",
        pages_visited: int = 0,
        rows_parsed: int | None = None,
        summary: dict | None = None,
    ) -> dict:
        """M1/M4: merge a batch and return its run record.

        A batch whose ``replay_key`` is already in the log is skipped, which makes a
        stream batch that is delivered again harmless. Raises ``ConcurrentBatchError`` if another
        writer publishes in between; nothing of this batch is visible then, and it can be appended again.
        """
        log = self.runs().agg(
            F.coalesce(F.max("batch_id"), F.lit(-1)).alias("last"),
            F.coalesce(F.max("max_id"), F.lit(0)).alias("max_id"),
        ).first()
        if replay_key is not None:
            done = self.runs().filter(F.col("replay_key") == replay_key).first()
            if done:
                return done.asDict()
        batch_id, attempt = log["last"] + 1, uuid.uuid4().hex
        started = utc_now()

        staged = written(first_wins(canonical(batch), copies="_copies"), "staged")
        known = written(self.known(staged), "known")
        stamp = F.lit(now.isoformat(" ")).cast("timestamp_ntz")

        counts = staged.agg(F.count("*").alias("unique"), F.coalesce(F.sum("_copies"), F.lit(0)).alias("total")).first()
        total, inserted = counts["total"], counts["unique"] - known.count()
        rows = numbered(staged, known, log["max_id"]).select("id", HASH, *TENDER_COLUMNS, stamp.alias("first_seen_at"))
        self._write_rows(rows, batch_id, attempt, inserted)
        self._write(known.select(HASH, stamp.alias("seen_at")), "seen", batch_id, attempt)

        record = {
            "batch_id": batch_id,
            "started_at": started,
            "finished_at": utc_now(),
            "mode": mode,
            "status": "ok",
            "target_year": target_year,
            "pages_visited": pages_visited,
            "rows_parsed": total if rows_parsed is None else rows_parsed,
            "rows_inserted": inserted,
            "duplicates_skipped": total - inserted,
            "failures_retries": 0,
            "error_message": None,
            "summary_json": json.dumps(summary or {}, ensure_ascii=False),
            "max_id": log["max_id"] + inserted,
            "replay_key": replay_key,
        }
        entry = self.spark.createDataFrame([tuple(record[f] for f in RUN_SCHEMA.names)], RUN_SCHEMA)
        self._write(entry.drop("batch_id").coalesce(1), "runs", batch_id, attempt)
        self._publish("published", str(batch_id), attempt)
        return record
