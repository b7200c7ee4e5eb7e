"""Fingerprint de-duplication and idempotent merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenderloom.functions.text import source_hash, strip_space
from tenderloom.operators.ordering import number_rows
from tenderloom.schema import TENDER_COLUMNS, TITLE
from tenderloom.shared import written

HASH = "source_hash"
STORED_COLUMNS = ("id", HASH, *TENDER_COLUMNS, "first_seen_at", "last_seen_at")


def arrival() -> list[Column]:
    """Arrival order of a record: page, then row on the page; unreadable numbers come last."""
    last = F.lit((1 << 63) - 1)
    return [F.coalesce(F.col(c).try_cast("long"), last).alias(c) for c in ("page_fetched", "row_index_on_page")]


def fingerprinted(df: DataFrame) -> DataFrame:
    return df if HASH in df.columns else df.withColumn(HASH, source_hash())


def first_wins(df: DataFrame, copies: str | None = None) -> DataFrame:
    """The earliest row per fingerprint, with the number of ``copies`` if asked for.

    A minimum over (arrival, row) merges inside each input task first, so a
    fingerprint shared by a third of all rows reaches the shuffle once per task.
    """
    df = fingerprinted(df)
    fields = [c for c in df.columns if c != HASH]
    earliest = F.min(F.struct(F.struct(*arrival()).alias("at"), F.struct(*fields).alias("row")))
    counted = [F.count(F.lit(1)).alias(copies)] if copies else []
    kept = df.groupBy(HASH).agg(earliest.alias("_first"), *counted)
    columns = [HASH if c == HASH else F.col("_first.row." + c).alias(c) for c in df.columns]
    return kept.select(*columns, *([copies] if copies else []))


def duplicate_counts(df: DataFrame) -> DataFrame:
    """Raw, de-duplicated and duplicate rows, and first rows without a title."""
    blank = F.length(strip_space(F.col(TITLE))) == 0
    per_hash = (
        fingerprinted(df)
        .select(HASH, F.struct(*arrival(), blank.alias("blank")).alias("at"))
        .groupBy(HASH)
        .agg(F.count("*").alias("copies"), F.min("at").alias("first"))
    )
    return per_hash.agg(
        F.count("*").alias("row_count_deduped"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count_raw"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_fingerprints"),
        F.count_if("first.blank").alias("rows_missing_object"),
    )


def known_hashes(base: DataFrame, staged: DataFrame) -> DataFrame:
    """Fingerprints of ``staged`` that the base already holds.

    The base is cut down by a semi join first: only its fingerprint column is read,
    and with a batch small enough for Spark to broadcast it is not shuffled.
    """
    return base.select(HASH).join(staged.select(HASH), HASH, "left_semi")


def numbered(staged: DataFrame, known: DataFrame | None = None, start: Column | int = 0) -> DataFrame:
    """Rows of ``staged`` whose fingerprint is not in ``known``, with ids after ``start`` in arrival order.

    Only fingerprints and places are sorted and written; they meet the rows, which are unique by fingerprint, in one
    join. ``staged`` is read twice, so it has to be a written table.
    """
    keys = staged.select(HASH, "page_fetched", "row_index_on_page")
    fresh = keys if known is None else keys.join(known, HASH, "left_anti")
    ids = number_rows(fresh, [*arrival(), F.col(HASH)], "id", start).select(HASH, "id")
    return staged.join(ids, HASH)


def first_load(batch: DataFrame, now: Column) -> DataFrame:
    """M5: a stored table from nothing."""
    rows = numbered(written(first_wins(batch), "staged"))
    return rows.withColumns({"first_seen_at": now, "last_seen_at": now}).select(*STORED_COLUMNS)


def merge(base: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """M1: the table after a batch. New fingerprints are inserted, known ones only
    move ``last_seen_at``, and nothing else changes, so replays are harmless.

    The batch is de-duplicated and written once; fingerprints are unique on both
    sides, so the joins have no hot key. New rows are numbered after the largest
    id, in arrival order.
    """
    staged = written(first_wins(batch), "staged")
    seen = staged.select(HASH, F.lit(True).alias("_seen"))
    last = F.when(F.col("_seen"), now).otherwise(F.col("last_seen_at"))
    kept = base.join(seen, HASH, "left").withColumn("last_seen_at", last).select(*STORED_COLUMNS)
    top = base.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    added = numbered(staged, known_hashes(base, staged), top).withColumns({"first_seen_at": now, "last_seen_at": now})
    return kept.unionByName(added.select(*STORED_COLUMNS))


def merge_counts(base: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows the batch would insert, and rows it would skip as already seen."""
    per_hash = fingerprinted(batch).groupBy(HASH).agg(F.count("*").alias("copies"))
    flagged = per_hash.join(base.select(HASH, F.lit(True).alias("_known")), HASH, "left")
    inserted = F.count_if(F.col("_known").isNull())
    return flagged.agg(
        inserted.alias("rows_inserted"),
        (F.coalesce(F.sum("copies"), F.lit(0)) - inserted).alias("duplicates_skipped"),
    )
