"""Mixing sources to target weights by iterative proportional fitting (operator 6).

Tokens are summed per cell (source, language, topic). Raking scales the cells in turn so
that their sums match a target share for every source, every language and every topic, and
repeats until all three fit. A document's inclusion probability is its cell's calibrated
weight times a constant that brings the expected tokens to the wanted fraction; documents
are then drawn by a hash of their id, so a rerun draws the same ones.

A null source, language or topic is a category of its own. Null and blank texts have no
tokens; they follow their cell's probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tenderloom.llm.common import stored

DIMENSIONS = ("source", "lang", "topic")
SWEEPS = 30
TOLERANCE = 1e-6


def word_count(text: Column) -> Column:
    """Tokens as runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def form_topic(text: Column) -> Column:
    """A document's form as its topic: tables, lines of notes, long or short prose."""
    length = F.length(text)
    bars = length - F.length(F.replace(text, F.lit("|"), F.lit("")))
    lines = length - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return (
        F.when(text.isNull() | (length == 0), "empty")
        .when(bars * 20 >= length, "table")
        .when(lines * 80 >= length, "notes")
        .when(length >= 4000, "long")
        .otherwise("short")
    )


def _category(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def tempered(cells: DataFrame, dimension: str, power: float = 0.7) -> DataFrame:
    """(category, target): shares of the dimension's tokens raised to ``power``, which lifts small ones."""
    sums = cells.groupBy(F.col(dimension).alias("category")).agg(F.sum("tokens").alias("_t"))
    lifted = sums.filter("_t > 0").select("category", F.pow(F.col("_t").cast("double"), F.lit(power)).alias("_p"))
    whole = lifted.agg(F.sum("_p").alias("p")).first()["p"] or 1.0
    return lifted.select("category", (F.col("_p") / F.lit(whole)).alias("target"))


def measured(docs: DataFrame, tokens: Column | None = None, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic (as categories), n_tokens per row."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        _category(F.col("source")).alias("source"),
        _category(F.col("lang")).alias("lang"),
        _category(form_topic(text) if topic is None else topic).alias("topic"),
        (word_count(text) if tokens is None else tokens).alias("n_tokens"),
    )


def rake(rows: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(source, lang, topic, tokens, share, weight): weight is the calibrated share over the share.

    Cells stay in tables: their number grows with the sources. A cell carries the three targets of its
    categories, so a sweep is one groupBy and one join per dimension, and the largest deviation comes
    to the driver with the write itself. Every exchange that Spark plans leaves a thread in the driver for
    a minute. Stops at ``TOLERANCE`` or, where the targets contradict empty cells, after ``SWEEPS`` sweeps.
    """
    sums = rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    cells = stored(sums.withColumn("tokens", F.coalesce("tokens", F.lit(0))), "cells")
    whole = cells.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("cells")).first()
    share = F.col("tokens") / F.lit(float(max(whole["tokens"] or 0, 1)))
    aimed = cells.withColumn("share", share).withColumn("fit", F.col("share"))
    for d in DIMENSIONS:
        goal = (targets or {}).get(d) or tempered(cells, d)
        aimed = aimed.join(goal.select(F.col("category").alias(d), F.col("target").alias("_" + d)), d, "left").fillna(0.0, ["_" + d])
    fitted = stored(aimed, "aimed")
    for _ in range(SWEEPS if whole["cells"] else 0):
        for dimension in DIMENSIONS:
            fitted = _scaled(fitted, dimension)
        seen = Observation()
        fitted = stored(fitted.observe(seen, F.max("_off").alias("off")).drop("_off"), "fitted")
        off = seen.get["off"]
        if off is None or off <= TOLERANCE:
            break
    weight = F.when(F.col("share") > 0, F.col("fit") / F.col("share")).otherwise(F.lit(0.0))
    return fitted.select(*DIMENSIONS, "tokens", "share", weight.alias("weight"))


def _scaled(fitted: DataFrame, dimension: str) -> DataFrame:
    """Scale each category of one dimension to its target; ``_off`` keeps the largest deviation seen."""
    sums = fitted.groupBy(dimension).agg(F.sum("fit").alias("_sum"))
    target, reached = F.col("_" + dimension), F.col("_sum")
    factor = F.when(reached > 0, target / reached).otherwise(F.lit(0.0))
    before = F.col("_off") if "_off" in fitted.columns else F.lit(0.0)
    kept = [c for c in fitted.columns if c not in ("fit", "_off")]
    joined = fitted.join(sums, dimension)
    return joined.select(*kept, (F.col("fit") * factor).alias("fit"), F.greatest(before, F.abs(target - reached)).alias("_off"))


def inclusion(cells: DataFrame, fraction: float) -> DataFrame:
    """(source, lang, topic, weight, probability): min(1, c * weight), with c such that the expected
    tokens are ``fraction`` of all. Each step spreads what capped cells can't give over the others."""
    sums = cells.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    budget, factor = fraction * sums, fraction
    for _ in range(20):
        full = F.col("weight") * F.lit(factor) >= 1
        got = cells.agg(
            F.sum(F.when(full, F.col("tokens"))).alias("full"),
            F.sum(F.when(~full, F.col("tokens") * F.col("weight"))).alias("rest"),
        ).first()
        rest, capped = got["rest"] or 0.0, got["full"] or 0
        if rest <= 0:
            break
        new = (budget - capped) / rest
        if abs(new - factor) <= 1e-9 * factor:
            break
        factor = max(new, factor)
    return cells.select(*DIMENSIONS, "weight", F.least(F.lit(1.0), F.col("weight") * F.lit(factor)).alias("probability"))


def drawn(id_col: Column, probability: Column, seed: str = "mix") -> Column:
    """True with the given probability, by a hash of the id; a null id is drawn as one value."""
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col), 11) / F.lit(float(1 << 53))
    return uniform < probability


def mix(docs: DataFrame, fraction: float = 0.5, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, lang, topic, n_tokens, weight, probability, kept."""
    rows = stored(measured(docs), "measured")
    chances = stored(inclusion(rake(rows, targets), fraction), "chances")
    joined = rows.join(chances, list(DIMENSIONS))
    return joined.select(
        "doc_id",
        *[F.when(F.col(d) != "null", F.substring(d, 2, 1 << 30)).alias(d) for d in DIMENSIONS],
        "n_tokens",
        "weight",
        "probability",
        drawn(F.col("doc_id"), F.col("probability")).alias("kept"),
    )


def sampled(docs: DataFrame, fraction: float = 0.5, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of ``docs`` that the calibrated draw keeps, with their columns.

    The probability comes from the row's own cell, which the row carries itself, so the texts
    meet the table of cells directly; Spark broadcasts that table while it is small.
    """
    rows = stored(measured(docs), "measured")
    chances = stored(inclusion(rake(rows, targets), fraction), "chances").select(
        *[F.col(d).alias(f"_cell_{d}") for d in DIMENSIONS], F.col("probability").alias("_probability")
    )
    text = F.col("text")
    own = docs.withColumns(
        {
            "_cell_source": _category(F.col("source")),
            "_cell_lang": _category(F.col("lang")),
            "_cell_topic": _category(form_topic(text)),
        }
    )
    met = own.join(chances, [f"_cell_{d}" for d in DIMENSIONS])
    return met.filter(drawn(F.col("doc_id"), F.col("_probability"))).select(*docs.columns)
