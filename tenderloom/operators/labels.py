"""Analyst labels: latest per tender, listing, attaching and appending."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tenderloom.functions.reasons import flag, from_flag, label_is_valid, list_from_json, reasons_from_json
from tenderloom.functions.text import optional_text, strip_space
from tenderloom.operators.classify import classify, snapshot
from tenderloom.operators.ordering import number_rows
from tenderloom.rules import DEFAULT_RULES, RuleSet

REVIEWER_LIMIT = 120
NOTE_LIMIT = 1000


def newest_first() -> list[Column]:
    """O6/O12."""
    return [F.desc("created_at"), F.desc("id")]


def latest_labels(labels: DataFrame, ties: str = "one") -> DataFrame:
    """Latest label per tender: ``one`` by (time, id), or ``keep`` every label of the last time.

    Both are aggregates that combine inside each task, so a tender with a third
    of all labels costs no more than any other.
    """
    if ties == "one":
        fields = [c for c in labels.columns if c not in ("tender_id", "created_at", "id")]
        newest = F.max_by(F.struct("created_at", "id", *fields), F.struct("created_at", "id"))
        best = labels.groupBy("tender_id").agg(newest.alias("_last"))
        return best.select(*[c if c == "tender_id" else F.col("_last." + c).alias(c) for c in labels.columns])
    if ties == "keep":
        last = labels.groupBy("tender_id").agg(F.max("created_at").alias("created_at"))
        return labels.join(last, ["tender_id", "created_at"]).select(*labels.columns)
    raise ValueError(f"ties must be 'one' or 'keep', not {ties!r}")


def label_listing(labels: DataFrame, tender_id: int | None = None, limit: int = 100) -> DataFrame:
    """Newest labels first, of one tender or of all."""
    chosen = labels if tender_id is None else labels.filter(F.col("tender_id") == tender_id)
    return chosen.orderBy(*newest_first()).limit(max(1, limit))


class AppendedLabels(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def new_labels(
    requests: DataFrame,
    tenders: DataFrame,
    created_at: Column,
    rules: RuleSet = DEFAULT_RULES,
    start: Column | int = 0,
) -> AppendedLabels:
    """M2: label requests with the tender's current classification frozen in.

    ``requests`` holds request_id, tender_id, label, reviewer and note. Only tenders
    that are asked about get classified, once each. Requests with an unknown label
    or tender come back with a reason instead.
    """
    cleaned = requests.select(
        "request_id",
        "tender_id",
        strip_space(F.col("label")).alias("label"),
        optional_text(F.col("reviewer"), REVIEWER_LIMIT).alias("reviewer"),
        optional_text(F.col("note"), NOTE_LIMIT).alias("note"),
    )
    asked = cleaned.select(F.col("tender_id").alias("id")).distinct()
    frozen = classify(tenders.join(asked, "id", "left_semi"), rules).select(
        F.col("id").alias("tender_id"), snapshot().alias("snapshot")
    )
    matched = cleaned.join(frozen, "tender_id", "left")
    valid, found = label_is_valid(F.col("label")), F.col("snapshot").isNotNull()
    rejected = matched.filter(~(valid & found)).select(
        "request_id",
        "tender_id",
        F.when(~valid, "invalid_label").otherwise("tender_not_found").alias("reason"),
    )
    accepted = number_rows(
        matched.filter(valid & found).withColumn("created_at", created_at), [F.col("request_id")], "id", start
    ).select("id", "tender_id", "label", "reviewer", "note", "created_at", "snapshot")
    return AppendedLabels(accepted, rejected)


def snapshot_to_columns(labels: DataFrame) -> DataFrame:
    """the flat form, flags as 0/1 and lists as JSON text."""
    s = F.col("snapshot")
    return labels.select(
        *[c for c in labels.columns if c != "snapshot"],
        s["score"].alias("snapshot_score"),
        s["confidence"].alias("snapshot_confidence"),
        F.to_json(s["top_signals"]).alias("snapshot_top_signals_json"),
        *[flag(s[c]).alias("snapshot_" + c) for c in ("broad_ok", "strict_ok", "near_miss_ok")],
        F.to_json(s["reasons"]).alias("snapshot_reasons_json"),
    )


def snapshot_from_columns(labels: DataFrame) -> DataFrame:
    """The nested form again; absent lists are empty."""
    nested = F.struct(
        F.col("snapshot_score").cast("int").alias("score"),
        F.col("snapshot_confidence").alias("confidence"),
        list_from_json(F.col("snapshot_top_signals_json")).alias("top_signals"),
        *[from_flag(F.col("snapshot_" + c)).alias(c) for c in ("broad_ok", "strict_ok", "near_miss_ok")],
        reasons_from_json(F.col("snapshot_reasons_json")).alias("reasons"),
    )
    keep = [c for c in labels.columns if not c.startswith("snapshot_")]
    return labels.select(*keep, nested.alias("snapshot"))
