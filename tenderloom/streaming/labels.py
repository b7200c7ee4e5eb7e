"""Analyst labels arriving as a stream: each micro-batch meets the tenders as they are and freezes their classification (M2)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tenderloom.functions.dates import utc_now
from tenderloom.operators.labels import new_labels
from tenderloom.rules import DEFAULT_RULES, RuleSet


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def stored_labels(spark: SparkSession, path: str) -> DataFrame | None:
    """The labels accepted so far; None before the first."""
    found = _stored(spark, f"{path}/accepted")
    return None if found is None else found.drop("batch")


def stored_rejects(spark: SparkSession, path: str) -> DataFrame | None:
    found = _stored(spark, f"{path}/rejected")
    return None if found is None else found.drop("batch")


def label_stream(
    requests: DataFrame,
    tenders: DataFrame,
    path: str,
    rules: RuleSet = DEFAULT_RULES,
    start: int = 0,
    clock: Callable[[], datetime] = utc_now,
) -> StreamingQuery:
    """Append every label request the stream holds, then stop.

    A micro-batch writes into folders of its own number, and its ids follow the largest one of the batches before
    it. If it is delivered again after a failure it replaces what it wrote, so every request is appended exactly
    once, whichever step failed. ``tenders`` is read anew for every batch: a label keeps the classification of its own time.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _stored(spark, f"{path}/accepted")
        last = None if before is None else before.filter(F.col("batch") < number).agg(F.max("id")).first()[0]
        now = F.lit(clock().isoformat(" ")).cast("timestamp_ntz")
        found = new_labels(batch, tenders, now, rules, start if last is None else last)
        found.accepted.write.mode("overwrite").parquet(f"{path}/accepted/batch={number}")
        found.rejected.write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")

    writer = requests.writeStream.foreachBatch(append).option("checkpointLocation", f"{path}/checkpoint")
    return writer.trigger(availableNow=True).start()
