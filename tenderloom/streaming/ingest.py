"""Structured Streaming ingest into the store."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tenderloom.functions.dates import utc_now
from tenderloom.operators.dedupe import HASH, fingerprinted
from tenderloom.operators.store import TenderStore


def upsert_stream(
    records: DataFrame,
    store: TenderStore,
    checkpoint: str,
    clock: Callable[[], datetime] = utc_now,
    mode: str = "bootstrap",
    target_year: str = "",
) -> StreamingQuery:
    """Merge everything the source holds now, micro-batch by micro-batch, then stop.

    The stream's own checkpoint resumes an interrupted run; the store skips a
    micro-batch it has already published.
    """

    def publish(batch: DataFrame, number: int) -> None:
        store.append(batch, clock(), replay_key=f"{checkpoint}#{number}", mode=mode, target_year=target_year)

    return (
        records.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def without_repeats(records: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Drop repeats of a fingerprint that arrive within ``delay``, before they reach the store.

    The store stays the authority; a dropped repeat does not move ``last_seen_at``.
    """
    return fingerprinted(records).withWatermark(event_time, delay).dropDuplicatesWithinWatermark([HASH])
