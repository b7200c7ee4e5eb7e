"""Sinks (S3, S7-S9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tenderloom.schema import TENDER_COLUMNS
from tenderloom.sources.tables import CSV_OPTIONS

BOM = "\ufeff"


def write_csv(df: DataFrame, path: str, columns: Sequence[str], order: list[Column], bom: bool = True) -> int:
    """Ordered part files with a header each, in place of what an earlier run left; returns the row count.

    Parts are ranges of the order, so read by name they give the sorted data set;
    no task ever holds all of it.
    """
    counted = Observation()
    first, *rest = columns
    named = df.orderBy(*order).select(F.col(first).alias(BOM + first if bom else first), *rest)
    named.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").options(**CSV_OPTIONS, emptyValue="").csv(path)
    return counted.get["rows"]


def write_tenders_csv(tenders: DataFrame, path: str, include_source_hash: bool = False) -> int:
    """S3: the whole table in (date, id) order."""
    columns = [*TENDER_COLUMNS, *(["source_hash"] if include_source_hash else [])]
    return write_csv(tenders, path, columns, [F.col("data_iso"), F.col("id")])


def write_report(report: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    report.write.mode("overwrite").json(path)
