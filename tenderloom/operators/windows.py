"""Which records and pages an ingest run takes."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tenderloom.functions.dates import at_time, in_window, iso_date, publication_date, publication_ts
from tenderloom.functions.text import strip_space
from tenderloom.operators.ordering import running_totals

EVERY_PAGE = 2**31 - 1


def of_year(year: str) -> Column:
    """P1."""
    return strip_space(F.col("viti")) == year


def of_two_days(year: str, today: date) -> Column:
    """Published today or the day before."""
    days = F.coalesce(publication_date().isin(today, today - timedelta(days=1)), F.lit(False))
    return of_year(year) & days


def of_window(year: str, lower: Column, upper: Column) -> Column:
    """Published between the high-water mark and now, both included."""
    return of_year(year) & in_window(publication_ts(), lower, upper)


def high_water_mark(tenders: DataFrame, year: str) -> DataFrame:
    """Latest publication timestamp stored for a year, null for an empty year."""
    dated = tenders.filter((F.col("viti") == year) & (F.trim(F.coalesce("data_iso", F.lit(""))) != ""))
    return dated.agg(F.max(at_time(iso_date(F.col("data_iso")), F.col("ora_publikimit"))).alias("latest"))


def daily_scope(year: str, mark: datetime | None, now: datetime) -> Column:
    """The window since the mark, or two days when the year is empty."""
    if mark is None:
        return of_two_days(year, now.date())
    return of_window(year, *(F.lit(t.isoformat(" ")).cast("timestamp_ntz") for t in (mark, now)))


def page_flags(rows: DataFrame, scope: Column) -> DataFrame:
    """One row per page number with whether any of its records is in scope."""
    page = F.col("page_fetched").cast("long").alias("page")
    return rows.groupBy(page).agg(F.coalesce(F.bool_or(scope), F.lit(False)).alias("matched"))


def visited_pages(flags: DataFrame, stale_pages: int = 3, max_pages: int | None = None) -> DataFrame:
    """The pages a run reads before ``stale_pages`` in a row have no record in scope.

    Pages between two matches share the number of matches so far, so a run of
    empty pages is a group of a plain aggregate; the cut is one scalar.
    """
    placed = running_totals(flags, "page", {"visit": F.lit(1), "hits": F.col("matched")})
    stale = (
        placed.filter(~F.col("matched"))
        .groupBy("hits")
        .agg(F.count("*").alias("empty"), F.min("visit").alias("first"))
        .filter(F.col("empty") >= stale_pages)
        .agg(F.min(F.col("first") + F.lit(stale_pages - 1)).alias("cut"))
    )
    last = F.coalesce(stale.scalar(), F.lit(EVERY_PAGE).cast("long"))
    if max_pages:
        last = F.least(last, F.lit(max_pages).cast("long"))
    return placed.filter(F.col("visit") <= last).select("page", "matched", "visit")
