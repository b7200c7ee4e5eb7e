"""Amounts, buckets and ratios."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tenderloom.functions.text import squeeze

# An amount opens the text and is followed by the currency name.
AMOUNT_PATTERN = r"(?iU)^([\d.,]+)\s*Lek"
AMOUNT_TYPE = "decimal(28,2)"


def plain_number(token: Column) -> Column:
    """digits with locale separators -> text with at most one decimal point."""
    comma, dot = F.contains(token, F.lit(",")), F.contains(token, F.lit("."))
    no_commas = F.replace(token, F.lit(","), F.lit(""))
    no_dots = F.replace(token, F.lit("."), F.lit(""))
    comma_is_decimal = F.replace(no_dots, F.lit(","), F.lit("."))
    return (
        F.when(comma & dot & F.rlike(token, F.lit(r",[^.]*$")), comma_is_decimal)
        .when(comma & dot, no_commas)
        .when(comma & F.rlike(token, F.lit(r"^[^,]*,[^,]{0,2}$")), comma_is_decimal)
        .when(comma, no_commas)
        .when(F.rlike(token, F.lit(r"\..*\.|^\d+\.\d{3}$")), no_dots)
        .otherwise(token)
    )


def parse_amount(col: Column) -> Column:
    """amount in lek, null when the text does not start with one."""
    text = F.replace(squeeze(col), F.lit("ë"), F.lit("e"))
    token = F.regexp_extract(text, AMOUNT_PATTERN, 1)
    return plain_number(token).try_cast(AMOUNT_TYPE)


def amount_text(amount: Column) -> Column:
    return F.coalesce(amount.cast("string"), F.lit(""))


def score_bucket(score: Column) -> Column:
    """F16: decade label such as 00-09; the last one is 100-100."""
    low = F.floor(score / 10).cast("int") * 10
    return F.format_string("%02d-%02d", low, F.least(low + 9, F.lit(100)))


def confidence_rank(confidence: Column) -> Column:
    """F17."""
    return F.when(confidence == "high", 3).when(confidence == "medium", 2).otherwise(1)


def clamp(value: Column, low: int, high: int) -> Column:
    """F18."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def ratio(part: Column, whole: Column) -> Column:
    """Quotient, 0 on an empty denominator."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def rounded(value: Column) -> Column:
    """F29."""
    return F.round(value, 4)
