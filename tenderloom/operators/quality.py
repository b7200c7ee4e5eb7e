"""Label quality: confusion, precision and recall, tiers, calibration, drift, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenderloom.functions.numbers import ratio, rounded
from tenderloom.functions.reasons import normalized_reasons
from tenderloom.operators.classify import classify_many
from tenderloom.operators.labels import latest_labels
from tenderloom.rules import RuleSet
from tenderloom.schema import CODE, CONFIDENCE_TIERS, KIND, LABEL_VALUES, TITLE
from tenderloom.shared import written

# Report order of the modes.
METRIC_MODES = ("strict", "broad", "near_miss")
CONFUSION = ("tp", "fp", "fn", "tn")

DIFF_KEYS = (
    "broad_ok",
    "broad_reasons",
    "strict_ok",
    "strict_excluded_reasons",
    "mixed_ok",
    "mixed_reasons",
    "near_miss_ok",
    "near_miss_reasons",
    "score",
    "confidence",
    "top_signals",
)


def _total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")


def latest_label_counts(labels: DataFrame) -> DataFrame:
    """W2 + A13 per tender: how many of its latest labels (ties kept) carry each value.

    Two small aggregates and no join: counts per (tender, time), then the last time's counts.
    """
    counts = [F.count_if(F.col("label") == v).alias(v) for v in LABEL_VALUES]
    per_time = labels.groupBy("tender_id", "created_at").agg(*counts)
    last = F.max(F.struct("created_at", *LABEL_VALUES)).alias("_last")
    return per_time.groupBy("tender_id").agg(last).select("tender_id", *[f"_last.{v}" for v in LABEL_VALUES])


def labelled_results(labels: DataFrame, tenders: DataFrame, rule_sets: dict[str, RuleSet]) -> DataFrame:
    """Classification of the labelled tenders, once each, without their texts.

    Texts meet only the distinct label ids (a broadcast while those are few), and
    what is joined to labels afterwards is narrow and already partitioned by id.
    """
    ids = labels.select(F.col("tender_id").alias("id")).distinct()
    records = tenders.select("id", TITLE, CODE, KIND).join(ids, "id", "left_semi")
    return classify_many(records, rule_sets).drop(TITLE, CODE, KIND)


def judged(labels: DataFrame, tenders: DataFrame, rule_sets: dict[str, RuleSet]) -> DataFrame:
    """One row per labelled tender with its label counts and a classification per rule set."""
    counted = latest_label_counts(labels).withColumnRenamed("tender_id", "id")
    return labelled_results(labels, tenders, rule_sets).join(counted, "id")


def confusion_cells(predicted: Column) -> dict[str, Column]:
    """A7 over tenders weighted by their label counts; ``maybe`` labels do not count."""
    return {
        "tp": F.when(predicted, F.col("relevant")),
        "fp": F.when(predicted, F.col("not_relevant")),
        "fn": F.when(~predicted, F.col("relevant")),
        "tn": F.when(~predicted, F.col("not_relevant")),
    }


def confusion(predicted: Column) -> list[Column]:
    return [_total(cell).alias(name) for name, cell in confusion_cells(predicted).items()]


def with_rates(df: DataFrame) -> DataFrame:
    """Precision, recall and F1, rounded as reported; 0 on empty denominators."""
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(F.lit(2.0) * precision * recall, precision + recall)
    return df.withColumns({"precision": rounded(precision), "recall": rounded(recall), "f1": rounded(f1)})


def _mode_rows(judgements: DataFrame, prefix: str) -> DataFrame:
    """All modes counted in one pass, then one row per mode."""
    cells = [F.struct(*confusion(F.col(f"{prefix}{m}_ok"))).alias(m) for m in METRIC_MODES]
    wide = judgements.agg(*cells)
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), *[F.col(f"{m}.{c}").alias(c) for c in CONFUSION]) for m in METRIC_MODES])
    return wide.select(F.inline(rows))


def metrics_by_mode(judgements: DataFrame, prefix: str = "") -> DataFrame:
    return with_rates(_mode_rows(judgements, prefix))


def tier_confusions(judgements: DataFrame, prefix: str = "") -> DataFrame:
    """A10: confusion of the strict decision per confidence tier; every tier has a row."""
    per_tier = [
        F.struct(
            F.lit(tier).alias("confidence"),
            *[
                _total(F.when(F.col(prefix + "confidence") == tier, cell)).alias(name)
                for name, cell in confusion_cells(F.col(prefix + "strict_ok")).items()
            ],
        ).alias(tier)
        for tier in CONFIDENCE_TIERS
    ]
    return judgements.agg(*per_tier).select(F.inline(F.array(*CONFIDENCE_TIERS)))


def mode_counts(judgements: DataFrame, prefix: str = "") -> DataFrame:
    """Labels used for metrics that fall on rows each mode accepts."""
    used = F.col("relevant") + F.col("not_relevant")
    return judgements.agg(*[_total(F.when(F.col(f"{prefix}{m}_ok"), used)).alias(m) for m in METRIC_MODES])


def label_totals(judgements: DataFrame) -> DataFrame:
    """A13."""
    used = F.col("relevant") + F.col("not_relevant")
    return judgements.agg(
        _total(used + F.col("maybe")).alias("labels_total"),
        _total(used).alias("labels_used_for_metrics"),
        _total(F.col("maybe")).alias("labels_maybe_excluded"),
    )


def calibration_deltas(judgements: DataFrame, before: str, after: str) -> DataFrame:
    """Both rule sets counted in the same pass, then compared per mode."""
    sides = {"before": before, "after": after}
    cells = [
        F.struct(*confusion(F.col(f"{prefix}{m}_ok"))).alias(f"{side}_{m}")
        for side, prefix in sides.items()
        for m in METRIC_MODES
    ]
    wide = judgements.agg(*cells)
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("mode"),
                *[F.col(f"{side}_{m}.{c}").alias(f"{side}_{c}") for side in sides for c in CONFUSION],
            )
            for m in METRIC_MODES
        ]
    )
    out = wide.select(F.inline(rows))
    for side in sides:
        tp, fp, fn = (F.col(f"{side}_{c}") for c in ("tp", "fp", "fn"))
        precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
        out = out.withColumns(
            {
                f"{side}_precision": rounded(precision),
                f"{side}_recall": rounded(recall),
                f"{side}_f1": rounded(ratio(F.lit(2.0) * precision * recall, precision + recall)),
            }
        )
    return out.withColumns(
        {
            "recall_delta": rounded(F.col("after_recall") - F.col("before_recall")),
            "precision_delta": rounded(F.col("after_precision") - F.col("before_precision")),
        }
    )


def regressions(deltas: DataFrame) -> DataFrame:
    """Modes whose recall dropped; any row closes the gate."""
    return deltas.filter(F.col("recall_delta") < 0).select(
        "mode", "recall_delta", F.concat_ws(" ", F.concat("mode", F.lit(": recall dropped")), "recall_delta").alias("message")
    )


def changed(left: str, right: str, names: tuple[str, ...]) -> Column:
    """Any of the named results differ."""
    out = F.lit(False)
    for name in names:
        out = out | ~F.col(left + name).eqNullSafe(F.col(right + name))
    return out


def latest_judgements(labels: DataFrame, tenders: DataFrame, rule_sets: dict[str, RuleSet]) -> DataFrame:
    """Every latest label (ties kept) next to the tender's classification."""
    last = latest_labels(labels, ties="keep").withColumnRenamed("id", "label_id")
    results = labelled_results(labels, tenders, rule_sets).withColumnRenamed("id", "tender_id")
    return last.join(results, "tender_id")


def _shown(name: str) -> Column:
    """A result as text; lists compare as sets."""
    value = F.col(name)
    listed = name.endswith("reasons") or name == "top_signals"
    return F.array_join(normalized_reasons(value), " | ") if listed else value.cast("string")


def row_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row per key and field where two tables disagree, by a join of both.

    Rows on one side only give a single ``present`` row.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, *[_shown(n).alias(n) for n in DIFF_KEYS], F.lit(True).alias("_here")).alias(name)

    pairs = side(left, "l").join(side(right, "r"), key, "full_outer")
    here_l, here_r = (F.coalesce(F.col(f"{s}._here"), F.lit(False)) for s in ("l", "r"))
    fields = [("present", here_l.cast("string"), here_r.cast("string"))]
    both = here_l & here_r
    fields += [(n, F.when(both, F.col(f"l.{n}")), F.when(both, F.col(f"r.{n}"))) for n in DIFF_KEYS]
    cells = F.array(*[F.struct(F.lit(n).alias("field"), a.alias("left"), b.alias("right")) for n, a, b in fields])
    return pairs.select(key, F.inline(cells)).filter(~F.col("left").eqNullSafe(F.col("right")))


# Leaves of the checksum tree, and how many of them a parent has.
DIFF_LEAVES = 1 << 16
DIFF_FAN = 1 << 8


def _leaf(key: str, leaves: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("leaf"), F.col(key)), F.lit(leaves)).cast("int")


def block_checksums(df: DataFrame, key: str, leaves: int = DIFF_LEAVES) -> DataFrame:
    """(leaf, rows, low, high): a checksum per block of keys, which does not depend on the order of rows.

    Sums of both halves of a 64-bit hash over all compared fields; they combine inside each task, so the shuffle has
    at most ``leaves`` rows per task. Kept next to a result table, they make the next comparison read no rows of equal blocks.
    """
    row = F.xxhash64(F.col(key), *[F.coalesce(_shown(n), F.lit("\x00")) for n in DIFF_KEYS])
    hashed = df.select(_leaf(key, leaves).alias("leaf"), row.alias("_h"))
    return hashed.groupBy("leaf").agg(
        F.count("*").alias("rows"),
        F.sum(F.col("_h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
        F.sum(F.shiftrightunsigned("_h", 32)).alias("high"),
    )


def differing_leaves(left: DataFrame, right: DataFrame, fan: int = DIFF_FAN) -> DataFrame:
    """(leaf) whose checksums differ, top-down: leaves are compared under parents that differ only."""
    sums = ("rows", "low", "high")

    def apart(a: DataFrame, b: DataFrame, at: str) -> DataFrame:
        same = F.lit(True)
        for n in sums:
            same = same & F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))
        return a.alias("a").join(b.alias("b"), at, "full_outer").filter(~same).select(at)

    def parents(df: DataFrame) -> DataFrame:
        # sums of sums may pass 64 bits, so they wrap around at 2^48
        return df.groupBy(F.floor(F.col("leaf") / fan).cast("int").alias("parent")).agg(
            F.sum("rows").alias("rows"), *[F.sum(F.col(n).bitwiseAND(F.lit((1 << 48) - 1))).alias(n) for n in ("low", "high")]
        )

    top = apart(parents(left), parents(right), "parent")
    under = lambda df: df.withColumn("parent", F.floor(F.col("leaf") / fan).cast("int")).join(top, "parent", "left_semi").drop("parent")
    return apart(under(left), under(right), "leaf")


def result_diff(
    left: DataFrame, right: DataFrame, key: str, leaves: int = DIFF_LEAVES, checksums: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """One row per key and field where two classification tables disagree.

    Only rows of key blocks whose checksums differ are joined. Both sides are read for the checksums, unless
    stored ones are given, and once more for the blocks that differ. Rows on one side only give a single
    ``present`` row. Lists compare as sets.
    """
    a, b = checksums or (block_checksums(left, key, leaves), block_checksums(right, key, leaves))
    blocks = written(differing_leaves(a, b), "differing")

    def rows(df: DataFrame) -> DataFrame:
        return df.withColumn("leaf", _leaf(key, leaves)).join(blocks, "leaf", "left_semi").drop("leaf")

    return row_diff(rows(left), rows(right), key)
