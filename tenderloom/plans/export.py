"""The export data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenderloom.functions.numbers import confidence_rank
from tenderloom.functions.reasons import joined
from tenderloom.operators.classify import classify, match_count
from tenderloom.rules import DEFAULT_RULES, RuleSet
from tenderloom.schema import TENDER_COLUMNS, canonical
from tenderloom.shared import written
from tenderloom.sources.sinks import write_csv

# Added columns, QC columns and the score text of an excluded row.
MATCH_COLUMNS = ("software_match_reason", "software_match_score", "software_confidence", "software_top_signals")
QC_COLUMNS = ("objekti_procedurave", "autoriteti_kontraktues", "software_match_score", "software_match_reason")
EXCLUDED = "excluded"
MIXED = "mixed_it_bundle"


def table_order() -> list[Column]:
    """O1."""
    return [F.col("data_iso"), F.col("id")]


def review_order() -> list[Column]:
    """Tier, score, date, then the row index compared as text."""
    score = F.col("software_match_score").cast("int")
    rank = confidence_rank(F.col("software_confidence"))
    return [F.desc(rank), F.desc(score), F.col("data_iso"), F.col("row_index_on_page"), F.col("id")]


def _with_match(rows: DataFrame, reasons: str) -> DataFrame:
    return rows.select(
        "id",
        *TENDER_COLUMNS,
        joined(F.col(reasons)).alias("software_match_reason"),
        F.col("score").cast("string").alias("software_match_score"),
        F.col("confidence").alias("software_confidence"),
        joined(F.col("top_signals")).alias("software_top_signals"),
    )


def broad_rows(classified: DataFrame) -> DataFrame:
    return _with_match(classified.filter("broad_ok"), "broad_reasons")


def strict_rows(classified: DataFrame) -> DataFrame:
    return _with_match(classified.filter("strict_ok"), "broad_reasons")


def near_miss_rows(classified: DataFrame, scope: str = "all") -> DataFrame:
    """U4: ``export`` keeps the narrower set of the exported file, mixed rows only."""
    chosen = {"all": F.col("near_miss_ok"), "export": F.col("near_miss_ok") & F.col("broad_ok")}[scope]
    return _with_match(classified.filter(chosen), "near_miss_reasons")


def qc_rows(classified: DataFrame) -> DataFrame:
    """A match row per broad row, followed by an excluded row where strict rejects it.

    Both come from one pass over the row, so they stay adjacent.
    """
    match = F.struct(
        F.lit(0).alias("step"),
        F.col("score").cast("string").alias("software_match_score"),
        joined(F.col("broad_reasons")).alias("software_match_reason"),
    )
    why = F.array_join(F.concat(F.array(F.lit(MIXED)), "mixed_reasons"), " | ")
    excluded = F.struct(
        F.lit(1).alias("step"), F.lit(EXCLUDED).alias("software_match_score"), why.alias("software_match_reason")
    )
    return _qc(classified, match, excluded)


def _qc(classified: DataFrame, match: Column, excluded: Column) -> DataFrame:
    entries = F.array_compact(F.array(match, F.when(F.col("mixed_ok"), excluded)))
    return classified.filter("broad_ok").select(
        "id", "data_iso", "objekti_procedurave", "autoriteti_kontraktues", F.inline(entries)
    )


def strict_qc_rows(qc: DataFrame) -> DataFrame:
    """U3."""
    return qc.filter(F.col("software_match_score") == EXCLUDED)


def export_counts(classified: DataFrame) -> DataFrame:
    """A4."""
    broad, strict, mixed = F.count_if("broad_ok"), F.count_if("strict_ok"), F.count_if("mixed_ok")
    return classified.agg(
        F.count("*").alias("full"),
        broad.alias("software_broad"),
        strict.alias("software_strict"),
        (broad - strict).alias("excluded_from_strict"),
        mixed.alias("near_miss_rows"),
        (broad + mixed).alias("qc_rows"),
    )


def export_all(tenders: DataFrame, out_dir: str, year: str, rules: RuleSet = DEFAULT_RULES) -> dict[str, int]:
    """Seven CSV data sets and their row counts.

    The classification is written once; each data set reads only its columns and rows.
    """
    kept = (
        "broad_ok",
        "broad_reasons",
        "strict_ok",
        "mixed_ok",
        "mixed_reasons",
        "near_miss_ok",
        "near_miss_reasons",
        "score",
        "confidence",
        "top_signals",
    )
    table = canonical(tenders, "id")
    classified = written(classify(table, rules).select("id", *TENDER_COLUMNS, *kept), "classified")
    qc = qc_rows(classified)
    qc_order = [*table_order(), F.col("step")]
    matched = [*TENDER_COLUMNS, *MATCH_COLUMNS]
    near = near_miss_rows(classified, scope="export")
    base = f"{out_dir.rstrip('/')}/registry_{str(year).strip()}"
    sets = {
        "canonical": (classified, "", TENDER_COLUMNS, table_order()),
        "software_broad": (broad_rows(classified), "_software_broad", matched, table_order()),
        "software_strict": (strict_rows(classified), "_software", matched, table_order()),
        "software_qc": (qc, "_software_qc", QC_COLUMNS, qc_order),
        "software_strict_qc": (strict_qc_rows(qc), "_software_strict_qc", QC_COLUMNS, qc_order),
        "software_near_miss": (near, "_software_near_miss", matched, table_order()),
        "software_review_queue": (near, "_software_review_queue", matched, review_order()),
    }
    return {
        name: write_csv(df, f"{base}{suffix}.csv", columns, order)
        for name, (df, suffix, columns, order) in sets.items()
    }


def legacy_rows(classified: DataFrame) -> dict[str, DataFrame]:
    """The older export, scored by the number of inclusion reasons."""
    count = match_count().cast("string")
    matched = classified.filter("broad_ok").select(
        "id",
        *TENDER_COLUMNS,
        "strict_ok",
        joined(F.col("broad_reasons")).alias("software_match_reason"),
        count.alias("software_match_score"),
    )
    match = F.struct(
        F.lit(0).alias("step"),
        count.alias("software_match_score"),
        joined(F.col("broad_reasons")).alias("software_match_reason"),
    )
    excluded = F.struct(
        F.lit(1).alias("step"),
        F.lit(EXCLUDED).alias("software_match_score"),
        joined(F.col("exclusion_reasons")).alias("software_match_reason"),
    )
    qc = _qc(classified, match, excluded)
    return {
        "broad": matched.drop("strict_ok"),
        "strict": matched.filter("strict_ok").drop("strict_ok"),
        "qc": qc,
        "strict_qc": strict_qc_rows(qc),
    }


def export_legacy(table_csv: DataFrame, out_dir: str, year: str, rules: RuleSet = DEFAULT_RULES) -> dict[str, int]:
    """S5 as CSV data sets, in arrival order of the input rows."""
    ordered = table_csv.withColumn("id", F.monotonically_increasing_id())
    classified = written(classify(ordered, rules), "legacy")
    suffixes = {"broad": "_software_broad", "strict": "_software", "qc": "_software_qc", "strict_qc": "_software_strict_qc"}
    base = f"{out_dir.rstrip('/')}/registry_{str(year).strip()}"
    counts = {}
    for name, df in legacy_rows(classified).items():
        qc = "qc" in name
        columns = QC_COLUMNS if qc else [*TENDER_COLUMNS, "software_match_reason", "software_match_score"]
        order = [F.col("id"), *([F.col("step")] if qc else [])]
        counts[name] = write_csv(df, f"{base}{suffixes[name]}.csv", columns, order)
    return counts
