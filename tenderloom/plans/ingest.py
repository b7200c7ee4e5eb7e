"""Ingest runs over a page corpus: whole year or since the last stored record."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, functions as F

from tenderloom.functions.dates import utc_now
from tenderloom.operators.extract import records
from tenderloom.operators.store import TenderStore
from tenderloom.operators.windows import EVERY_PAGE, daily_scope, high_water_mark, of_year, page_flags, visited_pages
from tenderloom.shared import written


def local_now(instant: datetime, timezone: str) -> datetime:
    """Naive wall-clock time of a zone."""
    return instant.astimezone(ZoneInfo(timezone)).replace(tzinfo=None)


def run_ingest(
    store: TenderStore,
    pages: DataFrame,
    mode: str,
    target_year: str,
    now: datetime,
    *,
    seen_at: datetime | None = None,
    stale_pages: int = 3,
    max_pages: int | None = None,
    ordinal: str = "page_id",
) -> dict:
    """Extract, filter and store one run; returns its run record.

    ``now`` is local wall-clock time, the unit of publication times; ``seen_at`` is the
    UTC time stamped on rows, the current one by default. Both modes may be run again at any time:
    rows already stored only get a later ``last_seen_at``.
    """
    if mode not in ("bootstrap", "daily"):
        raise ValueError(f"unknown mode: {mode}")
    parsed = written(records(pages, ordinal, empty_pages=True), "records")
    summary: dict = {}
    if mode == "bootstrap":
        scope, patience = of_year(target_year), EVERY_PAGE
    else:
        mark = high_water_mark(store.rows(), target_year).first()["latest"]
        scope, patience = daily_scope(target_year, mark, now), stale_pages
        summary["publication_window"] = (
            {"mode": "fallback_today_yesterday"}
            if mark is None
            else {"mode": "dynamic_last_record_to_now", "lower_bound": mark.isoformat(), "upper_bound": now.isoformat()}
        )
    found = parsed.filter(F.col("row_index_on_page").isNotNull())
    if patience < EVERY_PAGE or max_pages:
        visited = written(visited_pages(page_flags(parsed, scope), patience, max_pages), "visited")
        page = F.col("page").cast("string").alias("page_fetched")
        found = found.join(visited.select(page), "page_fetched", "left_semi")
    else:  # every page is read
        visited = parsed.select("page_fetched").distinct()
    return store.append(
        found.filter(scope),
        seen_at or utc_now(),
        mode=mode,
        target_year=target_year,
        pages_visited=visited.count(),
        rows_parsed=found.count(),
        summary=summary,
    )
