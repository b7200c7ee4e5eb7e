"""Quality, calibration, drift, validation and crawl reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenderloom.functions.numbers import score_bucket
from tenderloom.functions.reasons import flag, joined
from tenderloom.functions.text import strip_space
from tenderloom.operators import quality
from tenderloom.operators.classify import classify, invariant_violations
from tenderloom.operators.dedupe import duplicate_counts
from tenderloom.rules import DEFAULT_RULES, RuleSet
from tenderloom.schema import CODE, KIND, TITLE
from tenderloom.shared import written
from tenderloom.sources.sinks import write_csv

# Columns of the drift table.
DRIFT_COLUMNS = (
    "tender_id",
    "label",
    "timestamp",
    "snapshot_score",
    "current_score",
    "snapshot_confidence",
    "current_confidence",
    "snapshot_strict_ok",
    "current_strict_ok",
    "snapshot_near_miss_ok",
    "current_near_miss_ok",
    "snapshot_top_signals",
    "current_top_signals",
)

# Built-in cases every rule release must pass (name, title, code, kind, broad, strict).
SANITY_CASES = (
    ("antivirus_broad_keyword", "Mirëmbajtje antivirus dhe riparim printerësh", "", "", True, False),
    ("cpv_hardware_exclusion", "Shërbime IT", "50312000-5 - Some hardware repair CPV", "", True, False),
    ("pure_software_development", "Zhvillim software për portalin digjital", "72000000-5 - IT services", "", True, True),
)


def score_histogram(judgements: DataFrame) -> DataFrame:
    """Labels used for metrics per score decade."""
    used = F.col("relevant") + F.col("not_relevant")
    return (
        judgements.filter(used > 0)
        .groupBy(score_bucket(F.col("score")).alias("bucket"))
        .agg(F.sum(used).alias("labels"))
        .orderBy("bucket")
    )


def quality_report(labels: DataFrame, tenders: DataFrame, rules: RuleSet = DEFAULT_RULES) -> dict[str, DataFrame]:
    """The report's parts over one table of judged tenders, written once."""
    judgements = written(
        quality.judged(labels, tenders, {"": rules}).select(
            "id", "relevant", "not_relevant", "maybe", "broad_ok", "strict_ok", "near_miss_ok", "score", "confidence"
        ),
        "judged",
    )
    return {
        "label_counts": quality.label_totals(judgements),
        "mode_counts": quality.mode_counts(judgements),
        "metrics_by_mode": quality.metrics_by_mode(judgements),
        "confidence_tier_confusions_strict": quality.tier_confusions(judgements),
        "score_distribution_buckets": score_histogram(judgements),
    }


CALIBRATION_KEYS = ("score", "confidence", "strict_ok", "near_miss_ok")


def calibration_changes(
    labels: DataFrame, tenders: DataFrame, baseline: RuleSet, candidate: RuleSet
) -> DataFrame:
    """Judged labels whose tender the candidate rules decide differently."""
    pairs = quality.latest_judgements(labels, tenders, {"before_": baseline, "after_": candidate})
    judged = pairs.filter(F.col("label").isin("relevant", "not_relevant"))
    keys = [*CALIBRATION_KEYS, "top_signals"]
    return judged.filter(quality.changed("before_", "after_", CALIBRATION_KEYS)).select(
        "label_id",
        "tender_id",
        "label",
        "created_at",
        *[f"before_{k}" for k in keys],
        *[f"after_{k}" for k in keys],
    )


def calibration_report(
    labels: DataFrame,
    tenders: DataFrame,
    candidate: RuleSet,
    baseline: RuleSet = DEFAULT_RULES,
    reference_thresholds: bool = False,
    sample: int = 50,
) -> dict[str, DataFrame]:
    """R2: before/after metrics, regressions and the newest ``sample`` changed labels.

    The candidate's own confidence thresholds are used; ``reference_thresholds``
    keeps the baseline's for both sides.
    """
    if reference_thresholds:
        candidate = candidate.with_thresholds_of(baseline)
    judgements = quality.judged(labels, tenders, {"before_": baseline, "after_": candidate})
    deltas = quality.calibration_deltas(judgements, "before_", "after_")
    changes = calibration_changes(labels, tenders, baseline, candidate)
    return {
        "comparisons": deltas,
        "regressions": quality.regressions(deltas),
        "changed_tenders": changes.orderBy(F.desc("created_at"), F.desc("label_id")).limit(sample),
    }


def drift_table(labels: DataFrame, tenders: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Snapshot next to current result for every latest label."""
    pairs = quality.latest_judgements(labels, tenders, {"current_": rules})
    s = F.col("snapshot")

    def both(name: str, shape) -> list[Column]:
        return [shape(s[name]).alias("snapshot_" + name), shape(F.col("current_" + name)).alias("current_" + name)]

    return pairs.select(
        "label_id",
        "tender_id",
        "label",
        F.col("created_at").alias("timestamp"),
        *both("score", lambda c: c),
        *both("confidence", lambda c: c),
        *both("strict_ok", flag),
        *both("near_miss_ok", flag),
        *both("top_signals", joined),
    )


def drift_order() -> list[Column]:
    """O12."""
    return [F.desc("timestamp"), F.desc("label_id")]


def drift_report(drift: DataFrame, limit: int = 20) -> DataFrame:
    """Of the newest ``limit`` labels, those whose result moved since."""
    checked = drift.orderBy(*drift_order()).limit(max(1, limit))
    return checked.filter(quality.changed("snapshot_", "current_", ("score", "confidence", "strict_ok")))


def write_drift_csv(drift: DataFrame, path: str) -> int:
    """S8."""
    return write_csv(drift, path, DRIFT_COLUMNS, drift_order())


def validation_counts(classified: DataFrame) -> DataFrame:
    """A3: all counts in one pass."""
    broad, strict = F.count_if("broad_ok"), F.count_if("strict_ok")
    return classified.agg(
        F.count("*").alias("total_full_rows"),
        broad.alias("broad_rows"),
        strict.alias("strict_rows"),
        (broad - strict).alias("excluded_from_strict_count"),
        F.count_if("near_miss_ok").alias("near_miss_rows"),
        F.count_if("mixed_ok").alias("mixed_it_bundle_rows"),
        F.count_if(F.size(invariant_violations()) > 0).alias("classification_invariant_violations"),
    )


def excluded_samples(classified: DataFrame, limit: int = 5, width: int = 120) -> DataFrame:
    """First excluded titles in (date, id) order."""
    titled = classified.select("id", "data_iso", "broad_ok", "strict_ok", strip_space(F.col(TITLE)).alias("title"))
    return (
        titled.filter(F.col("broad_ok") & ~F.col("strict_ok") & (F.col("title") != ""))
        .orderBy("data_iso", "id")
        .limit(limit)
        .select("id", F.substring("title", 1, width).alias("title"))
    )


def sanity_cases(spark: SparkSession, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """The built-in cases with their outcome."""
    names = ["case", TITLE, CODE, KIND, "expect_broad", "expect_strict"]
    results = classify(spark.createDataFrame(list(SANITY_CASES), names), rules)
    ok = (F.col("broad_ok") == F.col("expect_broad")) & (F.col("strict_ok") == F.col("expect_strict"))
    return results.select(
        "case",
        ok.alias("ok"),
        F.col("broad_ok").alias("broad"),
        F.col("strict_ok").alias("strict"),
        F.col("strict_excluded_reasons").alias("excluded_reasons"),
    )


def sanity_all_ok(cases: DataFrame) -> DataFrame:
    """A20."""
    return cases.agg(F.bool_and("ok").alias("all_ok"))


def validation_report(
    tenders: DataFrame, rules: RuleSet = DEFAULT_RULES
) -> dict[str, DataFrame]:
    """R5/R6."""
    classified = classify(tenders, rules)
    cases = sanity_cases(tenders.sparkSession, rules)
    return {
        "counts": validation_counts(classified),
        "sample_excluded_titles": excluded_samples(classified),
        "sanity_cases": cases,
        "sanity_all_ok": sanity_all_ok(cases),
    }


def crawl_qc(records: DataFrame, target_year: str) -> DataFrame:
    """Duplicate and missing-title counts of a crawl, with the last page reached."""
    pages = records.agg(
        F.max(F.col("page_fetched").try_cast("long")).alias("last_page_number"),
        F.count_distinct("page_fetched").alias("pages_with_rows"),
    )
    return one_row(duplicate_counts(records), pages).withColumn("target_year", F.lit(target_year))


def one_row(*parts: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def run_metrics(run: DataFrame, classified: DataFrame, judgements: DataFrame) -> DataFrame:
    """The counters of all stages of a run as one row."""
    counts = classified.agg(
        F.count("*").alias("export_full"),
        F.count_if("broad_ok").alias("export_software_broad"),
        F.count_if("strict_ok").alias("export_software_strict"),
        F.count("*").alias("validate_total_full"),
        F.count_if("broad_ok").alias("validate_broad"),
        F.count_if("strict_ok").alias("validate_strict"),
        F.count_if(F.size(invariant_violations()) > 0).alias("validate_invariant_violations"),
    )
    feedback = quality.label_totals(judgements).select(
        F.col("labels_total").alias("feedback_labels_total"),
        F.col("labels_used_for_metrics").alias("feedback_labels_used"),
    )
    stage = ("pages_visited", "rows_parsed", "rows_inserted", "duplicates_skipped", "failures_retries")
    return one_row(run.select(*stage), counts, feedback)
