"""Registered queries: every operator run over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenderloom.catalog import adapters as a
from tenderloom.functions import dates, numbers, reasons, text
from tenderloom.operators import dedupe, extract, labels as lab, ordering, quality, windows
from tenderloom.operators.classify import classify, classify_many
from tenderloom.operators.dedupe import HASH, fingerprinted
from tenderloom.operators.statistics import RegistryCounts
from tenderloom.operators.store import TenderStore
from tenderloom.plans import export, lint, reports, search
from tenderloom.plans.ingest import run_ingest
from tenderloom.rules import DEFAULT_RULES
from tenderloom.schema import TENDER_COLUMNS, TITLE
from tenderloom.shared import new_path, written
from tenderloom.streaming.daily import daily_stream, load_stream
from tenderloom.streaming.ingest import upsert_stream, without_repeats
from tenderloom.streaming.labels import label_stream, stored_labels, stored_rejects

Query = Callable[[SparkSession, str], DataFrame]

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
BASE_TIME, MERGE_TIME = "2024-06-01 00:00:00", "2024-06-02 00:00:00"
RUN_TIME = datetime(2024, 6, 1)

_QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    _QUERIES[run.__name__] = run
    return run


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _shown(ts: Column | str) -> Column:
    return F.date_format(ts, TS_FORMAT)


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return classify(a.tenders(spark, sf), a.CURRENT_RULES)


# --- classification ---------------------------------------------------------------


@query
def stats_by_mode(spark, sf):
    return search.registry_stats(a.tenders(spark, sf), a.CURRENT_RULES)


@query
def stats_default_rules(spark, sf):
    return search.registry_stats(a.tenders(spark, sf), DEFAULT_RULES)


@query
def classify_flags(spark, sf):
    return _classified(spark, sf).select("id", "broad_ok", "exclusion_ok", "strict_ok", "mixed_ok", "near_miss_ok")


@query
def reason_lists(spark, sf):
    lists = ("broad_reasons", "exclusion_reasons", "strict_excluded_reasons", "mixed_reasons", "near_miss_reasons")
    return _classified(spark, sf).select(
        "id", *[reasons.joined(reasons.normalized_reasons(F.col(c))).alias(c) for c in lists]
    )


@query
def scores_and_tiers(spark, sf):
    return _classified(spark, sf).select("id", "score", "confidence")


@query
def top_signals(spark, sf):
    return _classified(spark, sf).select("id", reasons.joined(F.col("top_signals")).alias("top_signals"))


@query
def validation_report(spark, sf):
    return reports.validation_counts(_classified(spark, sf))


@query
def sample_excluded_titles(spark, sf):
    return reports.excluded_samples(_classified(spark, sf))


@query
def result_diff(spark, sf):
    both = classify_many(a.tenders(spark, sf), {"l_": a.CURRENT_RULES, "r_": a.CANDIDATE_RULES})
    table = written(both.select("id", *[p + k for p in ("l_", "r_") for k in quality.DIFF_KEYS]), "diff")

    def side(prefix):
        return table.select("id", *[F.col(prefix + k).alias(k) for k in quality.DIFF_KEYS])

    return quality.result_diff(side("l_"), side("r_"), "id")


@query
def stats_maintained(spark, sf):
    """Statistics after two batches and a change of rules, from deltas alone."""
    counts = RegistryCounts(spark, new_path(spark, "counts"))
    rows = a.tenders(spark, sf)
    first = windows.of_year("2024")
    counts.add(rows.filter(first), a.CURRENT_RULES, "batch-0")
    counts.add(rows.filter(~first), a.CURRENT_RULES, "batch-1")
    counts.change_rules(rows, a.CURRENT_RULES, a.CANDIDATE_RULES, "rules-1")
    return counts.current()


@query
def rule_lint(spark, sf):
    return lint.lint(spark, a.tenders(spark, sf), a.OVERLAPPING_RULES)


# --- scalar functions -------------------------------------------------------------


@query
def normalized_text(spark, sf):
    normal = text.combined_text()
    return a.tenders(spark, sf).select("id", F.md5(normal).alias("digest"), F.length(normal).cast("long").alias("length"))


@query
def cpv_codes(spark, sf):
    raw = F.concat_ws(" ", "kodi_cpv_raw", TITLE, "kodi_cpv_raw")
    return a.tenders(spark, sf).select("id", reasons.joined(text.parse_cpv_codes(raw)).alias("codes"))


@query
def source_hash(spark, sf):
    return a.tenders(spark, sf).select("id", text.source_hash().alias("source_hash"))


@query
def display_text(spark, sf):
    return a.tenders(spark, sf).select("id", text.ellipsis(F.col(TITLE)).alias("shown"))


@query
def amount_parse(spark, sf):
    """Order totals spelled in the registry's number formats, parsed back."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    whole, rest = F.floor(cents / 100), F.lpad((cents % 100).cast("string"), 2, "0")
    comma = F.format_number(whole, 0)
    dot = F.translate(comma, ",", ".")
    spellings = [
        F.concat(comma, F.lit("."), rest, F.lit(" Lekë")),
        F.concat(dot, F.lit(","), rest, F.lit(" Lek")),
        F.concat(whole, F.lit(","), rest, F.lit(" lek")),
        F.concat(whole, F.lit("."), rest, F.lit("  LEK")),
        F.concat(dot, F.lit(" Leke")),
        F.concat(comma, F.lit("Lekë")),
        F.concat(F.lit("Pa fond "), whole, F.lit(" Lek")),
        F.concat(whole, F.lit("."), rest, F.lit("5 Lek")),
    ]
    orders = a.table(spark, sf, "orders")
    spelled = F.element_at(F.array(*spellings), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return orders.select("o_orderkey", numbers.amount_text(numbers.parse_amount(spelled)).alias("amount"))


@query
def date_parse(spark, sf):
    day = F.col("o_orderdate")
    spellings = [
        F.concat_ws("-", F.day(day), F.month(day), F.year(day)),
        F.concat(F.lit("  "), F.date_format(day, "dd-MM-yyyy"), F.lit("\n")),
        F.concat(F.lit("31-2-"), F.year(day)),
        F.date_format(day, "dd/MM/yyyy"),
    ]
    spelled = F.element_at(F.array(*spellings), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return a.table(spark, sf, "orders").select(
        "o_orderkey", dates.iso_text(dates.parse_local_date(spelled)).alias("data_iso")
    )


@query
def time_parse(spark, sf):
    hour, minute = F.hour("ts"), F.lpad(F.minute("ts").cast("string"), 2, "0")
    spellings = [
        F.concat(hour, F.lit(":"), minute),
        F.concat(F.lit("Ora "), hour, F.lit(" . "), minute),
        F.concat(hour + 20, F.lit(":"), minute),
        F.lit("no-time"),
    ]
    spelled = F.element_at(F.array(*spellings), (F.col("event_id") % 4 + 1).cast("int"))
    return a.table(spark, sf, "events").select(
        "event_id", F.coalesce(dates.publication_time(spelled), F.lit(-1)).alias("minutes")
    )


@query
def publication_times(spark, sf):
    return a.tenders(spark, sf).select("id", _shown(dates.publication_ts()).alias("published"))


# --- fingerprints and merging -----------------------------------------------------


@query
def dedupe_first_wins(spark, sf):
    return dedupe.first_wins(a.tenders(spark, sf)).select("source_hash", "id", "page_fetched", "row_index_on_page")


@query
def crawl_qc(spark, sf):
    return reports.crawl_qc(a.tenders(spark, sf), "2024")


def _base_table(spark: SparkSession, sf: str) -> DataFrame:
    first_year = a.tenders(spark, sf).filter(windows.of_year("2024")).drop("id")
    return dedupe.first_load(first_year, F.lit(BASE_TIME).cast("timestamp_ntz"))


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    batch = a.tenders(spark, sf).drop("id")
    return dedupe.merge(_base_table(spark, sf), batch, F.lit(MERGE_TIME).cast("timestamp_ntz"))


def _stored(df: DataFrame) -> DataFrame:
    times = [_shown(c).alias(c) for c in ("first_seen_at", "last_seen_at")]
    return df.select("id", "source_hash", "viti", "page_fetched", "row_index_on_page", "fondi_limit_lek", *times)


@query
def upsert_merge(spark, sf):
    return _stored(_merged(spark, sf))


@query
def upsert_stats(spark, sf):
    return dedupe.merge_counts(_base_table(spark, sf), a.tenders(spark, sf).drop("id"))


@query
def upsert_replay(spark, sf):
    again = dedupe.merge(_merged(spark, sf), a.tenders(spark, sf).drop("id"), F.lit("2024-06-03").cast("timestamp_ntz"))
    return _stored(again)


@query
def surrogate_ids(spark, sf):
    rows = a.tenders(spark, sf).select(F.col("id").alias("tender"), "data_iso")
    return ordering.number_rows(rows, [F.desc("data_iso"), F.asc("tender")], "position", start=100)


# --- ingest windows ---------------------------------------------------------------


@query
def year_filter(spark, sf):
    return a.tenders(spark, sf).filter(windows.of_year("2025")).select("id", "viti")


@query
def two_day_fallback(spark, sf):
    return a.tenders(spark, sf).filter(windows.of_two_days("2025", date(2024, 3, 2))).select("id", "data_iso")


WINDOW = ("2024-03-01 06:30:00", "2024-09-15 12:00:00")


@query
def window_filter(spark, sf):
    lower, upper = (F.lit(t).cast("timestamp_ntz") for t in WINDOW)
    found = a.tenders(spark, sf).filter(windows.of_window("2026", lower, upper))
    return found.select("id", _shown(dates.publication_ts()).alias("published"))


@query
def high_water_mark(spark, sf):
    return windows.high_water_mark(a.tenders(spark, sf), "2025").select(_shown("latest").alias("latest"))


@query
def stale_page_cut(spark, sf):
    rows = a.tenders(spark, sf)
    scope = windows.of_window("2025", *(F.lit(t).cast("timestamp_ntz") for t in ("2024-02-01", "2024-03-15")))
    flags = windows.page_flags(rows, scope)
    return windows.visited_pages(flags, stale_pages=3).select("page", "matched", "visit")


@query
def page_cap(spark, sf):
    rows = a.tenders(spark, sf)
    flags = windows.page_flags(rows, windows.of_year("2025"))
    read = windows.visited_pages(flags, stale_pages=1000, max_pages=7)
    return read.agg(F.count("*").alias("pages_visited"), F.max("page").alias("last_page"))


# --- labels -----------------------------------------------------------------------


def _label_rows(df: DataFrame) -> DataFrame:
    return df.select("id", "tender_id", "label", "reviewer", "note", _shown("created_at").alias("created_at"))


@query
def latest_label_one(spark, sf):
    return _label_rows(lab.latest_labels(a.labels(spark, sf), ties="one"))


@query
def latest_label_ties(spark, sf):
    return _label_rows(lab.latest_labels(a.labels(spark, sf), ties="keep"))


@query
def label_listing(spark, sf):
    return _label_rows(lab.label_listing(a.labels(spark, sf), limit=100))


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every driver label as a request; some name no tender or carry an unknown label."""
    doc = F.col("doc_id")
    return a.table(spark, sf, "labels").select(
        (doc + 1).alias("request_id"),
        F.when(doc % 10 == 3, doc + 1_000_000_000).otherwise(doc + 1).alias("tender_id"),
        F.when(doc % 10 == 4, "unsure").when(F.col("quality") == 1, " relevant ").otherwise("maybe").alias("label"),
        F.concat(F.lit("  Analyst "), doc % 7, F.lit(" ")).alias("reviewer"),
        F.when(doc % 2 == 0, F.lit(" ")).otherwise(F.repeat(F.lit("note "), 300)).alias("note"),
    )


def _appended(spark: SparkSession, sf: str) -> lab.AppendedLabels:
    now = F.lit(BASE_TIME).cast("timestamp_ntz")
    return lab.new_labels(_requests(spark, sf), a.tenders(spark, sf), now, a.CURRENT_RULES, start=500)


def _accepted_columns(accepted: DataFrame) -> DataFrame:
    s = F.col("snapshot")
    return accepted.select(
        "id", "tender_id", "label", "reviewer", F.coalesce(F.length("note"), F.lit(0)).cast("long").alias("note_length"),
        s["score"].alias("score"), s["confidence"].alias("confidence"), s["strict_ok"].alias("strict_ok"),
        reasons.joined(F.array_sort(s["reasons"]["near_miss"])).alias("near_miss"),
    )


@query
def label_append(spark, sf):
    return _accepted_columns(_appended(spark, sf).accepted)


@query
def streaming_labels(spark, sf):
    """The requests of ``label_append`` as a stream in two parts; a row that says whether it was accepted."""
    path = new_path(spark, "labels")
    requests = _requests(spark, sf)
    middle = requests.agg(F.max("request_id")).first()[0] // 2
    for part in (F.col("request_id") <= middle, F.col("request_id") > middle):
        requests.filter(part).write.mode("append").parquet(path + "/in")
        source = spark.readStream.schema(requests.schema).parquet(path + "/in")
        label_stream(source, a.tenders(spark, sf), path, a.CURRENT_RULES, start=500, clock=lambda: RUN_TIME).awaitTermination()
    accepted = _accepted_columns(stored_labels(spark, path)).select("id", "tender_id", "label", "score", "strict_ok", F.lit("").alias("reason"))
    rejected = stored_rejects(spark, path).select(
        F.lit(-1).cast("long").alias("id"), "tender_id", F.lit("").alias("label"), F.lit(-1).alias("score"), F.lit(False).alias("strict_ok"), "reason"
    )
    return accepted.unionByName(rejected)


@query
def label_rejects(spark, sf):
    return _appended(spark, sf).rejected


@query
def snapshot_json_roundtrip(spark, sf):
    flat = lab.snapshot_to_columns(a.snapshot_labels(spark, sf))
    s = F.col("snapshot")
    return lab.snapshot_from_columns(flat).select(
        "id", s["score"].alias("score"), s["confidence"].alias("confidence"), s["broad_ok"].alias("broad_ok"),
        reasons.joined(s["top_signals"]).alias("top_signals"),
        reasons.joined(F.array_sort(s["reasons"]["broad"])).alias("broad"),
        reasons.joined(F.array_sort(s["reasons"]["mixed"])).alias("mixed"),
    )


# --- search -----------------------------------------------------------------------


def _page_columns(result: search.SearchResult, *extra: str) -> DataFrame:
    items = result.items
    shown = [c for c in ("score", "confidence") if c in items.columns]
    return items.select("id", "data_iso", "autoriteti_kontraktues", "kodi_cpv_raw", *shown, *extra)


@query
def search_text_page(spark, sf):
    result = search.search_page(a.tenders(spark, sf), a.labels(spark, sf), q="  QUE ", page=2, page_size=30)
    return _page_columns(result, "latest_label", "latest_reviewer")


@query
def search_mode_page(spark, sf):
    result = search.search_page(
        a.tenders(spark, sf), a.labels(spark, sf), software="near_miss", sort="oldest", rules=a.CURRENT_RULES, page=1
    )
    return _page_columns(result, "latest_label")


@query
def search_confidence_page(spark, sf):
    result = search.search_page(
        a.tenders(spark, sf), software="strict", confidence="low", rules=a.CURRENT_RULES, page=2, page_size=10
    )
    return _page_columns(result)


@query
def search_fields_page(spark, sf):
    result = search.search_page(
        a.tenders(spark, sf), authority="AUTORITETI e", cpv="7", koha_zhvillimit="muaji 1", sort="publication_asc", page_size=100
    )
    return _page_columns(result, "koha_zhvillimit")


def _index(spark: SparkSession, sf: str):
    index = search.tender_index(spark, new_path(spark, "trigrams"))
    index.append(a.tenders(spark, sf))
    return index


@query
def search_indexed(spark, sf):
    """Text filters over several fields through the trigram index."""
    found = search.matching(_index(spark, sf), q="  QUE ", authority="iteti ES", cpv="12")
    return found.select("id", "data_iso", "autoriteti_kontraktues", "kodi_cpv_raw")


@query
def search_indexed_page(spark, sf):
    result = search.search_page(_index(spark, sf), a.labels(spark, sf), q="Tion", sort="oldest", software="broad", rules=a.CURRENT_RULES, page=2)
    return _page_columns(result, "latest_label")


@query
def search_deep_page(spark, sf):
    """The page in the middle of all tenders, newest first."""
    pages = search.search_pages(a.tenders(spark, sf))
    return pages.page(pages.total() // 2 // 25 + 1, 25).select(F.col("_row").alias("position"), "id", "data_iso", "kodi_cpv_raw")


@query
def search_reviewer(spark, sf):
    found = search.matching(a.tenders(spark, sf), a.labels(spark, sf), reviewer="analyst 3")
    return found.select("id", "autoriteti_kontraktues")


@query
def search_totals(spark, sf):
    found = search.matching(a.tenders(spark, sf), q="der", software="broad", rules=a.CURRENT_RULES)
    return search.page_totals(found, 25)


@query
def tender_detail(spark, sf):
    detail = search.tender_detail(a.tenders(spark, sf), a.labels(spark, sf), 9, a.CURRENT_RULES)
    shown = F.transform("analyst_labels", lambda e: F.concat_ws(":", e["label_id"], e["label"], e["reviewer"]))
    return detail.select("id", TITLE, "broad_ok", "strict_ok", F.array_join(shown, ",").alias("analyst_labels"))


# --- feedback ---------------------------------------------------------------------


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judged(a.labels(spark, sf), a.tenders(spark, sf), {"": a.CURRENT_RULES})


@query
def quality_metrics_by_mode(spark, sf):
    return quality.metrics_by_mode(_judged(spark, sf))


@query
def quality_tiers(spark, sf):
    return quality.tier_confusions(_judged(spark, sf))


@query
def score_histogram(spark, sf):
    return reports.score_histogram(_judged(spark, sf))


@query
def label_counts(spark, sf):
    return quality.label_totals(_judged(spark, sf))


@query
def mode_counts(spark, sf):
    return quality.mode_counts(_judged(spark, sf))


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    both = {"before_": a.CURRENT_RULES, "after_": a.CANDIDATE_RULES}
    return quality.calibration_deltas(
        quality.judged(a.labels(spark, sf), a.tenders(spark, sf), both), "before_", "after_"
    )


@query
def calibration_compare(spark, sf):
    return _deltas(spark, sf)


@query
def calibration_regressions(spark, sf):
    return quality.regressions(_deltas(spark, sf)).select("mode", "recall_delta")


@query
def calibration_changed(spark, sf):
    changes = reports.calibration_changes(
        a.labels(spark, sf), a.tenders(spark, sf), a.CURRENT_RULES, a.CANDIDATE_RULES
    )
    keys = [p + k for p in ("before_", "after_") for k in reports.CALIBRATION_KEYS]
    return changes.select("label_id", "tender_id", "label", *keys)


def _drift(spark: SparkSession, sf: str) -> DataFrame:
    return reports.drift_table(a.snapshot_labels(spark, sf), a.tenders(spark, sf), a.CURRENT_RULES)


@query
def drift_rows(spark, sf):
    return _drift(spark, sf).select("label_id", *reports.DRIFT_COLUMNS).withColumn("timestamp", _shown("timestamp"))


@query
def drift_report(spark, sf):
    found = reports.drift_report(_drift(spark, sf), limit=50)
    return found.select("label_id", "tender_id", "snapshot_score", "current_score", "snapshot_strict_ok", "current_strict_ok")


# --- export -----------------------------------------------------------------------


def _export_columns(df: DataFrame) -> DataFrame:
    """Reason texts as sorted lists, the form both engines can compare."""
    listed = F.array_sort(F.split("software_match_reason", r" \| "))
    return df.select(
        "id", "autoriteti_kontraktues", reasons.joined(listed).alias("software_match_reason"),
        "software_match_score", "software_confidence", "software_top_signals",
    )


@query
def export_broad(spark, sf):
    return _export_columns(export.broad_rows(_classified(spark, sf)))


@query
def export_strict(spark, sf):
    return _export_columns(export.strict_rows(_classified(spark, sf)))


@query
def export_near_miss(spark, sf):
    return _export_columns(export.near_miss_rows(_classified(spark, sf), scope="export"))


@query
def near_miss_all(spark, sf):
    return _export_columns(export.near_miss_rows(_classified(spark, sf), scope="all"))


def _qc_columns(qc: DataFrame) -> DataFrame:
    listed = F.array_sort(F.split("software_match_reason", r" \| "))
    return qc.select("id", "step", "software_match_score", reasons.joined(listed).alias("software_match_reason"))


@query
def export_qc(spark, sf):
    return _qc_columns(export.qc_rows(_classified(spark, sf)))


@query
def export_strict_qc(spark, sf):
    return _qc_columns(export.strict_qc_rows(export.qc_rows(_classified(spark, sf))))


@query
def export_counts(spark, sf):
    return export.export_counts(_classified(spark, sf))


@query
def review_queue(spark, sf):
    near = export.near_miss_rows(_classified(spark, sf), scope="export")
    fields = ("id", "software_confidence", "software_match_score", "data_iso", "row_index_on_page")
    return ordering.number_rows(near.select(*fields), export.review_order(), "position")


@query
def canonical_order(spark, sf):
    rows = a.tenders(spark, sf).select("id", "data_iso", "autoriteti_kontraktues")
    return ordering.number_rows(rows, export.table_order(), "position")


@query
def legacy_counts(spark, sf):
    return _qc_columns(export.legacy_rows(_classified(spark, sf))["qc"])


# --- pages ------------------------------------------------------------------------


@query
def page_blocks(spark, sf):
    pages = a.table(spark, sf, "pages")
    items = F.regexp_extract_all("html", F.lit(r"(?s)<li>(.*?)</li>"), F.lit(1))
    blocks = pages.select("page_id", F.posexplode(items).alias("position", "block"))
    return blocks.select("page_id", "position", extract.html_text(F.col("block")).alias("content"))


@query
def page_fields(spark, sf):
    pages = a.table(spark, sf, "pages")
    found = {t: F.regexp_extract("html", rf"(?s)<{t}\b[^>]*>(.*?)</{t}>", 1) for t in ("title", "h1")}
    return pages.select("page_id", *[extract.html_text(c, " ").alias(t) for t, c in found.items()])


@query
def page_counters(spark, sf):
    number, total = extract.page_counter(F.col("html"))
    return a.result_pages(spark, sf).select("page_id", number.alias("page_number"), total.alias("page_total"))


@query
def page_records(spark, sf):
    return extract.records(a.stored_pages(spark, sf))


# --- stored registry --------------------------------------------------------------


@query
def bootstrap_ingest(spark, sf):
    store = TenderStore(spark, new_path(spark, "store"))
    run_ingest(store, a.stored_pages(spark, sf), "bootstrap", "2025", RUN_TIME, seen_at=RUN_TIME)
    return _stored(store.tenders())


@query
def daily_ingest(spark, sf):
    """A daily run on a store that ends on 1 June adds only what was published since, from every page."""
    store = TenderStore(spark, new_path(spark, "store"))
    rows = a.tenders(spark, sf)
    upper = datetime(2024, 6, 30, 12, 0)
    store.append(rows.filter(F.col("data_iso") <= "2024-06-01").drop("id"), RUN_TIME)
    run_ingest(store, a.stored_pages(spark, sf), "daily", "2025", upper, seen_at=upper, stale_pages=windows.EVERY_PAGE)
    return _stored(store.tenders())


@query
def run_metrics(spark, sf):
    store = TenderStore(spark, new_path(spark, "store"))
    run_ingest(store, a.stored_pages(spark, sf), "bootstrap", "2025", RUN_TIME, seen_at=RUN_TIME)
    classified = classify(store.tenders(), a.CURRENT_RULES)
    judged = quality.judged(a.labels(spark, sf), a.tenders(spark, sf), {"": a.CURRENT_RULES})
    return reports.run_metrics(store.runs(), classified, judged)


@query
def streaming_upsert(spark, sf):
    path = new_path(spark, "stream")
    source = a.table_stream(spark, sf, "documents")
    store = TenderStore(spark, path + "/store")
    stream = upsert_stream(a.tenders_of(source).drop("id"), store, path + "/checkpoint", clock=lambda: RUN_TIME)
    stream.awaitTermination()
    return _stored(store.tenders())


@query
def store_merge(spark, sf):
    """The merge of ``upsert_merge`` through the store: bucketed, filtered by Bloom filters, compacted in between."""
    store = TenderStore(spark, new_path(spark, "store"))
    rows = a.tenders(spark, sf)
    store.append(rows.filter(windows.of_year("2024")).drop("id"), datetime.fromisoformat(BASE_TIME))
    store.compact()
    store.append(rows.drop("id"), datetime.fromisoformat(MERGE_TIME))
    store.compact()
    return _stored(store.tenders())


class _Interrupted(RuntimeError):
    pass


class _InterruptedStore(TenderStore):
    """Loses its first batch between the write and the publication."""

    def _publish(self, folder: str, name: str, attempt: str) -> None:
        raise _Interrupted(name)


@query
def streaming_resume(spark, sf):
    """A stream that fails before it publishes its first batch and is started again with the same checkpoint."""
    path = new_path(spark, "stream")

    def drain(store: TenderStore) -> None:
        source = a.table_stream(spark, sf, "documents")
        upsert_stream(a.tenders_of(source).drop("id"), store, path + "/checkpoint", clock=lambda: RUN_TIME).awaitTermination()

    try:
        drain(_InterruptedStore(spark, path + "/store"))
    except StreamingQueryException as error:
        if "_Interrupted" not in str(error):
            raise
    store = TenderStore(spark, path + "/store")
    drain(store)
    return _stored(store.tenders())


@query
def streaming_daily(spark, sf):
    """A first load up to 1 June, then a run over all tenders that starts from the mark in the state store."""
    path = new_path(spark, "stream")
    store, upper = TenderStore(spark, path + "/store"), datetime(2024, 6, 30, 12, 0)
    rows = a.tenders(spark, sf).drop("id")

    def source():
        return spark.readStream.schema(rows.schema).parquet(path + "/in")

    rows.filter(F.col("data_iso") <= "2024-06-01").write.parquet(path + "/in")
    load_stream(source(), store, path, clock=lambda: RUN_TIME)
    rows.write.mode("append").parquet(path + "/in")
    daily_stream(source(), store, path, "2025", upper, clock=lambda: upper)
    return _stored(store.tenders())


DEDUPE_PARTS = 4


@query
def streaming_dedupe(spark, sf):
    """Repeats of a fingerprint within twelve hours are dropped by the state store, in one run per part of the tenders.

    A part arrives a day after the one before, so the state of a part is still there for the next one and gone for those
    after it. Every fiftieth tender of the last part carries a time of the first day, which is behind the watermark.
    """
    path = new_path(spark, "stream")
    part = F.col("id") % DEDUPE_PARTS
    late = (part == DEDUPE_PARTS - 1) & (F.col("id") % 50 == 7)
    seconds = F.when(late, 0).otherwise(part) * 86400 + F.length(TITLE) % 3600
    at = F.timestamp_seconds(F.lit(1_700_000_000) + seconds)
    rows = fingerprinted(a.tenders(spark, sf)).select(HASH, part.cast("int").alias("part"), at.alias("at"))
    for number in range(DEDUPE_PARTS):
        rows.filter(F.col("part") == number).write.mode("append").parquet(path + "/in")
        source = spark.readStream.schema(rows.schema).parquet(path + "/in")
        kept = without_repeats(source, "at", "12 hours").select(HASH, "part")
        writer = kept.writeStream.format("parquet").option("checkpointLocation", path + "/checkpoint")
        writer.trigger(availableNow=True).start(path + "/out").awaitTermination()
    return spark.read.parquet(path + "/out")
