"""Search, detail and registry statistics."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenderloom.functions.numbers import confidence_rank
from tenderloom.functions.text import contains_ignoring_ascii_case
from tenderloom.operators.classify import classify, mode_predicate
from tenderloom.operators.labels import latest_labels, newest_first
from tenderloom.operators.ordering import SortedPages, page_slice
from tenderloom.operators.trigrams import TrigramIndex
from tenderloom.rules import DEFAULT_RULES, RuleSet
from tenderloom.schema import CONFIDENCE_TIERS, SOFTWARE_MODES, TENDER_COLUMNS
from tenderloom.shared import written

DEFAULT_PAGE_SIZE = 25
MAX_PAGE_SIZE = 100
REVIEWER_FILTER_LIMIT = 120

# Accepted spellings of the two orders.
NEWEST = ("newest", "publication_desc", "desc", "data_desc")
OLDEST = ("oldest", "publication_asc", "asc", "data_asc")

RESULT_COLUMNS = ("score", "confidence", "top_signals")
LATEST_COLUMNS = ("label", "reviewer", "note", "created_at")


class SearchResult(NamedTuple):
    items: DataFrame
    totals: DataFrame


# What each text filter looks at, and all of these fields once.
SEARCHED = {
    "q": ("objekti_procedurave", "autoriteti_kontraktues", "kodi_cpv_raw"),
    "authority": ("autoriteti_kontraktues",),
    "cpv": ("kodi_cpv_raw",),
    "koha_zhvillimit": ("koha_zhvillimit",),
}
SEARCHED_FIELDS = ("objekti_procedurave", "autoriteti_kontraktues", "kodi_cpv_raw", "koha_zhvillimit")


def needles(**texts: str | None) -> list[tuple[str, tuple[str, ...]]]:
    """(needle, fields) of the text filters that are not blank."""
    if unknown := texts.keys() - SEARCHED.keys():
        raise TypeError(f"unknown text filters {sorted(unknown)}")
    return [(texts[f].strip(), columns) for f, columns in SEARCHED.items() if texts.get(f) and texts[f].strip()]


def text_filters(**texts: str | None) -> list[Column]:
    """Literal substring filters ``q``, ``authority``, ``cpv`` and ``koha_zhvillimit``; blank ones are ignored."""
    return [
        reduce(lambda a, b: a | b, [contains_ignoring_ascii_case(F.col(c), needle) for c in columns]) for needle, columns in needles(**texts)
    ]


def tender_index(spark: SparkSession, path: str, **sizes: int) -> TrigramIndex:
    """The trigram index that text filters use instead of a scan."""
    return TrigramIndex(spark, path, SEARCHED_FIELDS, **sizes)


def reviewed_by(tenders: DataFrame, labels: DataFrame | None, reviewer: str | None) -> DataFrame:
    """Tenders whose latest label has a matching reviewer; none without labels."""
    if not reviewer or not reviewer.strip():
        return tenders
    if labels is None:
        return tenders.filter(F.lit(False))
    needle = reviewer.strip()[:REVIEWER_FILTER_LIMIT]
    last = latest_labels(labels).filter(contains_ignoring_ascii_case(F.col("reviewer"), needle))
    return tenders.join(last.select(F.col("tender_id").alias("id")), "id", "left_semi")


def result_order(sort: str, software: str) -> list[Column]:
    """O2-O4."""
    if sort in NEWEST:
        by_date = [F.desc_nulls_last("data_iso"), F.desc("id")]
    elif sort in OLDEST:
        by_date = [F.asc_nulls_first("data_iso"), F.asc("id")]
    else:
        raise ValueError(f"unknown order {sort!r}")
    if software == "none":
        return by_date
    return [F.desc(confidence_rank(F.col("confidence"))), F.desc("score"), *by_date]


def matching(
    tenders: DataFrame | TrigramIndex,
    labels: DataFrame | None = None,
    *,
    software: str = "none",
    confidence: str | None = None,
    reviewer: str | None = None,
    rules: RuleSet = DEFAULT_RULES,
    **texts: str | None,
) -> DataFrame:
    """All filters; text and reviewer filters run before the classification.

    The confidence filter only applies together with a software mode (P10). With a trigram index
    in place of the table, only blocks that may hold the texts are read; the rows are the same.
    """
    if software not in ("none", *SOFTWARE_MODES):
        raise ValueError(f"unknown software mode {software!r}")
    if confidence not in (None, "any", *CONFIDENCE_TIERS):
        raise ValueError(f"unknown confidence {confidence!r}")
    found = tenders.candidates(needles(**texts)) if isinstance(tenders, TrigramIndex) else tenders
    for condition in text_filters(**texts):
        found = found.filter(condition)
    found = reviewed_by(found, labels, reviewer)
    if software == "none":
        return found
    found = classify(found, rules).filter(mode_predicate(software))
    if confidence in CONFIDENCE_TIERS:
        found = found.filter(F.col("confidence") == confidence)
    return found


def with_latest_label(items: DataFrame, labels: DataFrame) -> DataFrame:
    """The latest label of each of the few rows of a page, null where there is none."""
    # at most MAX_PAGE_SIZE ids
    ids = F.broadcast(items.select(F.col("id").alias("tender_id")))
    last = latest_labels(labels.join(ids, "tender_id", "left_semi"))
    renamed = last.select(
        F.col("tender_id").alias("id"), *[F.col(c).alias("latest_" + c) for c in LATEST_COLUMNS]
    )
    return items.join(F.broadcast(renamed), "id", "left")


def search_pages(
    tenders: DataFrame | TrigramIndex, labels: DataFrame | None = None, *, sort: str = "newest", software: str = "none", **filters
) -> SortedPages:
    """All matching tenders in order, for pages of any depth."""
    found = matching(tenders, labels, software=software, **filters)
    extra = RESULT_COLUMNS if software != "none" else ()
    return SortedPages(found.select("id", *TENDER_COLUMNS, *extra), result_order(sort, software))


def search_page(
    tenders: DataFrame | TrigramIndex,
    labels: DataFrame | None = None,
    *,
    page: int = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    sort: str = "newest",
    software: str = "none",
    **filters,
) -> SearchResult:
    """One page of matching tenders with their latest labels, and the totals.

    The page holds at most 100 rows and is written, because both the label
    lookup and the result read it. ``search_pages`` serves a result that is paged through.
    """
    if page < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"pages count from 1 and hold 1 to {MAX_PAGE_SIZE} rows")
    found = matching(tenders, labels, software=software, **filters)
    extra = RESULT_COLUMNS if software != "none" else ()
    order = result_order(sort, software)
    items = page_slice(found.select("id", *TENDER_COLUMNS, *extra), order, page, page_size)
    if labels is not None:
        items = with_latest_label(written(items, "page"), labels)
    return SearchResult(items.orderBy(*order), page_totals(found, page_size))


def page_totals(found: DataFrame, page_size: int) -> DataFrame:
    """Total and number of pages, at least one."""
    total = F.count(F.lit(1))
    return found.agg(
        total.alias("total"),
        F.greatest(F.lit(1), F.ceil(total / F.lit(page_size))).cast("long").alias("page_count"),
    )


def registry_stats(tenders: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """All four counts in one pass without a filter."""
    return classify(tenders, rules).agg(
        F.count("*").alias("total"),
        F.count_if("broad_ok").alias("software_broad"),
        F.count_if("strict_ok").alias("software_strict"),
        F.count_if("near_miss_ok").alias("near_miss"),
    )


def tender_detail(
    tenders: DataFrame, labels: DataFrame, tender_id: int, rules: RuleSet = DEFAULT_RULES, limit: int = 10
) -> DataFrame:
    """One tender with its classification and its newest labels, newest first."""
    row = classify(tenders.filter(F.col("id") == tender_id), rules)
    own = labels.filter(F.col("tender_id") == tender_id).orderBy(*newest_first()).limit(limit)
    entry = F.struct("created_at", F.col("id").alias("label_id"), "label", "reviewer", "note")
    listed = own.groupBy(F.col("tender_id").alias("id")).agg(
        F.sort_array(F.collect_list(entry), asc=False).alias("analyst_labels")
    )
    shown = ("broad_ok", "strict_ok", "broad_reasons", "strict_excluded_reasons")
    return row.select(*tenders.columns, *shown).join(listed, "id", "left")
