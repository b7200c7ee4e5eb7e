"""The daily run as a stream: the high-water mark is a streaming maximum kept in the state store."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tenderloom.functions.dates import publication_ts, utc_now
from tenderloom.functions.text import strip_space
from tenderloom.operators.store import TenderStore
from tenderloom.operators.windows import daily_scope
from tenderloom.streaming.ingest import upsert_stream

MARKS = "year string, latest timestamp_ntz"


def mark_stream(records: DataFrame, marks: str, checkpoint: str) -> StreamingQuery:
    """Latest publication time per year over all records ever streamed, one row per year.

    The maximum is state, so a later run with the same checkpoint goes on from it. Every micro-batch writes the years it
    moved into a folder of its own number, which a repeated batch replaces.
    """
    years = records.groupBy(strip_space(F.col("viti")).alias("year")).agg(F.max(publication_ts()).alias("latest"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.filter("latest is not null").write.mode("overwrite").parquet(f"{marks}/batch={number}")

    writer = years.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def stored_mark(spark: SparkSession, marks: str, year: str) -> datetime | None:
    """The mark that the last run left."""
    try:
        rows = spark.read.schema(MARKS).parquet(marks)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.filter(F.col("year") == year).agg(F.max("latest")).first()[0]


def load_stream(
    records: DataFrame, store: TenderStore, path: str, scope: Column | None = None, clock: Callable[[], datetime] = utc_now, **run: str
) -> None:
    """Drain a stream into the store and move the marks by the same records.

    Both queries read everything the source holds. The marks come last: if a run dies between them, the next one takes
    its records again, which the store knows already.
    """
    taken = records if scope is None else records.filter(scope)
    upsert_stream(taken, store, f"{path}/checkpoint", clock=clock, **run).awaitTermination()
    mark_stream(taken, f"{path}/marks", f"{path}/marks-checkpoint").awaitTermination()


def daily_stream(
    records: DataFrame, store: TenderStore, path: str, year: str, now: datetime, clock: Callable[[], datetime] = utc_now
) -> datetime | None:
    """Store what the stream holds of the window since the mark, both ends included; returns the mark used.

    Records published before the mark are late and left out, as the daily run does. Without a mark the run takes
    two days. A stream has no pages, so there is no stop after pages without a match.
    """
    mark = stored_mark(store.spark, f"{path}/marks", year)
    load_stream(records, store, path, daily_scope(year, mark, now), clock, mode="daily", target_year=year)
    return mark
