"""Rule-driven classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenderloom.functions.numbers import clamp
from tenderloom.functions.reasons import prefixed, signal_label
from tenderloom.functions.text import NORM_STEPS, joined_record_text, text_of
from tenderloom.operators.staging import computed_once
from tenderloom.rules import DEFAULT_RULES, RuleSet, code_regex, keyword_regex
from tenderloom.schema import CODE, KIND, TITLE

HIT_LISTS = ("kw", "cpv", "ex_kw", "ex_cpv", "near_kw", "near_cpv")

RESULT_COLUMNS = (
    "broad_ok",
    "broad_reasons",
    "exclusion_ok",
    "exclusion_reasons",
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


def _no_hits() -> Column:
    return F.array().cast("array<string>")


def _keyword_hits(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(keyword_regex(patterns)), F.lit(0)))


def _nonempty_keyword_hits(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.array_remove(_keyword_hits(text, patterns), "") if patterns else _no_hits()


def _code_hits(raw: Column, prefixes: tuple[str, ...]) -> Column:
    regex = code_regex(prefixes)
    if regex is None:
        return _no_hits()
    return F.array_distinct(F.regexp_extract_all(raw, F.lit(regex), F.lit(0)))


def _some(items: Column) -> Column:
    return F.size(items) > 0


def with_hits(
    df: DataFrame,
    rule_sets: dict[str, RuleSet],
    title: str = TITLE,
    code: str = CODE,
    kind: str = KIND,
) -> DataFrame:
    """Distinct hits per rule list, in order of appearance; ``{prefix}_hits_{list}`` columns.

    The text is normalised once for all rule sets; near-miss words are only
    looked for in records that no inclusion rule accepts.
    """
    out = computed_once(df, {"_text0": joined_record_text(title, code, kind), "_code": text_of(code)})
    for i, step in enumerate(NORM_STEPS):
        out = computed_once(out, {f"_text{i + 1}": step(F.col(f"_text{i}"))}).drop(f"_text{i}")
    out = out.withColumnRenamed(f"_text{len(NORM_STEPS)}", "_text")
    text, raw = F.col("_text"), F.col("_code")
    first: dict[str, Column] = {}
    second: dict[str, Column] = {}
    for prefix, rules in rule_sets.items():
        hits = f"{prefix}_hits_"
        first[hits + "kw"] = _nonempty_keyword_hits(text, rules.include_keyword_patterns)
        first[hits + "cpv"] = _code_hits(raw, rules.include_cpv_prefixes)
        first[hits + "ex_kw"] = _nonempty_keyword_hits(text, rules.exclude_keyword_patterns)
        first[hits + "ex_cpv"] = _code_hits(raw, rules.exclude_cpv_prefixes)
        broad = _some(F.col(hits + "kw")) | _some(F.col(hits + "cpv"))
        for name, found in (
            ("near_kw", _keyword_hits(text, rules.near_miss_keyword_patterns)),
            ("near_cpv", _code_hits(raw, rules.near_miss_cpv_prefixes)),
        ):
            second[hits + name] = F.when(broad, _no_hits()).otherwise(found)
    return computed_once(computed_once(out, first), second).drop("_text", "_code")


def result_columns(rules: RuleSet, prefix: str) -> dict[str, Column]:
    """C7-C14 over the hit lists of ``with_hits``."""
    kw, cpv, ex_kw, ex_cpv, near_kw, near_cpv = (F.col(f"{prefix}_hits_{n}") for n in HIT_LISTS)
    w = rules.weights

    broad = _some(kw) | _some(cpv)
    excluded = _some(ex_kw) | _some(ex_cpv)
    strict, mixed = broad & ~excluded, broad & excluded
    near = mixed | _some(near_kw) | _some(near_cpv)

    broad_reasons = F.concat(prefixed(kw, "kw:"), prefixed(cpv, "cpv:"))
    exclusion_reasons = F.concat(prefixed(ex_kw, "exclude_kw:"), prefixed(ex_cpv, "exclude_cpv:"))
    mixed_reasons = F.when(mixed, F.concat(broad_reasons, exclusion_reasons)).otherwise(_no_hits())
    near_reasons = F.when(mixed, prefixed(mixed_reasons, "mixed_it_bundle:")).otherwise(
        F.concat(prefixed(near_kw, "near_kw:"), prefixed(near_cpv, "near_cpv:"))
    )

    mixed_count = F.when(mixed, F.size(kw) + F.size(cpv) + F.size(ex_kw) + F.size(ex_cpv)).otherwise(0)
    signals = (
        ("status:broad", F.when(broad, w["broad_bonus"])),
        ("status:strict", F.when(strict, w["strict_bonus"])),
        ("status:mixed_it_bundle", F.when(mixed, w["mixed_bundle_bonus"])),
        ("include_kw_hits", F.when(_some(kw), F.size(kw) * w["include_keyword_hit"])),
        ("include_cpv_hits", F.when(_some(cpv), F.size(cpv) * w["include_cpv_hit"])),
        ("exclude_kw_hits", F.when(_some(ex_kw), F.size(ex_kw) * w["exclude_keyword_hit"])),
        ("exclude_cpv_hits", F.when(_some(ex_cpv), F.size(ex_cpv) * w["exclude_cpv_hit"])),
        ("near_kw_hits", F.when(_some(near_kw), F.size(near_kw) * w["near_keyword_hit"])),
        ("near_cpv_hits", F.when(_some(near_cpv), F.size(near_cpv) * w["near_cpv_hit"])),
        ("mixed_near_hits", F.when(mixed, mixed_count * w["mixed_bundle_bonus"])),
    )
    raw_score = sum((F.coalesce(weight, F.lit(0)) for _, weight in signals), F.lit(0))
    score = clamp(raw_score, rules.score_min, rules.score_max)
    ranked = F.sort_array(
        F.array_compact(
            F.array(
                *[
                    F.when(
                        weight.isNotNull(),
                        F.struct(F.abs(weight).alias("size"), weight.alias("weight"), F.lit(name).alias("name")),
                    )
                    for name, weight in signals
                ]
            )
        ),
        asc=False,
    )
    top = F.transform(F.slice(ranked, 1, rules.top_signal_count), lambda s: signal_label(s["name"], s["weight"]))
    return {
        "broad_ok": broad,
        "broad_reasons": broad_reasons,
        "exclusion_ok": excluded,
        "exclusion_reasons": exclusion_reasons,
        "strict_ok": strict,
        "strict_excluded_reasons": F.when(mixed, exclusion_reasons).otherwise(_no_hits()),
        "mixed_ok": mixed,
        "mixed_reasons": mixed_reasons,
        "near_miss_ok": near,
        "near_miss_reasons": near_reasons,
        "score": score,
        "confidence": F.when(score >= rules.high_threshold, "high")
        .when(score >= rules.medium_threshold, "medium")
        .otherwise("low"),
        "top_signals": top,
    }


def classify_many(
    df: DataFrame,
    rule_sets: dict[str, RuleSet],
    *,
    title: str = TITLE,
    code: str = CODE,
    kind: str = KIND,
) -> DataFrame:
    """One pass over the records for several rule sets; results carry ``prefix``."""
    hits = with_hits(df, rule_sets, title, code, kind)
    added = [
        column.alias(prefix + name)
        for prefix, rules in rule_sets.items()
        for name, column in result_columns(rules, prefix).items()
    ]
    return hits.select(*df.columns, *added)


def classify(df: DataFrame, rules: RuleSet = DEFAULT_RULES, **columns: str) -> DataFrame:
    """Add the classification result columns to tender records."""
    return classify_many(df, {"": rules}, **columns)


def mode_predicate(mode: str, prefix: str = "") -> Column:
    """C18."""
    names = {"broad": "broad_ok", "strict": "strict_ok", "near_miss": "near_miss_ok"}
    return F.col(prefix + names[mode])


def snapshot(prefix: str = "") -> Column:
    """The nested result frozen into labels."""
    reasons = F.create_map(
        F.lit("broad"), F.col(prefix + "broad_reasons"),
        F.lit("strict_excluded"), F.col(prefix + "strict_excluded_reasons"),
        F.lit("near_miss"), F.col(prefix + "near_miss_reasons"),
        F.lit("mixed"), F.col(prefix + "mixed_reasons"),
    )
    names = ("score", "confidence", "top_signals", "broad_ok", "strict_ok", "near_miss_ok")
    return F.struct(*[F.col(prefix + n).alias(n) for n in names], reasons.alias("reasons"))


def invariant_violations(prefix: str = "") -> Column:
    """Messages of the consistency checks that fail."""
    strict, broad, excluded = (F.col(prefix + n) for n in ("strict_ok", "broad_ok", "exclusion_ok"))
    unexplained = ~strict & broad & excluded & (F.size(prefix + "strict_excluded_reasons") == 0)
    return F.array_compact(
        F.array(
            F.when(strict & ~broad, F.lit("strict without broad")),
            F.when(strict & excluded, F.lit("strict in spite of an exclusion")),
            F.when(unexplained, F.lit("not strict, yet no reason given")),
        )
    )


def match_count(prefix: str = "") -> Column:
    """Score of the older export, the number of inclusion reasons."""
    return F.size(prefix + "broad_reasons")
